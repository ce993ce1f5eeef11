"""A session with the settings the engine is designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "foldlake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=settings | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a private one only where it is unset, as in tests."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foldlake-shared-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds batches for Python by bytes and not by rows only; the session has the bound when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: every later use sees the same rows in the same places."""
    path = f"{shared_dir(df.sparkSession)}/foldlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._foldlake_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table of ``settled`` that no later plan reads."""
    spark, path = df.sparkSession, df._foldlake_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
