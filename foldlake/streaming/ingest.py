"""Telemetry from a stream of JSON lines into a store that takes records up to a size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldlake.operators.state import ranged
from foldlake.session import release, settled
from foldlake.streaming.streams import VersionedTable, telemetry


def stored(records: DataFrame, room: int, size: Column, order: str) -> DataFrame:
    """``records`` with ``_kept``: whether the sizes before a record, in order, leave room.  The record that reaches the cap is still taken."""
    sized, parts = ranged(records.withColumn("_size", size.cast("bigint")), [order])
    own = F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("_own") - F.col("_size") + F.col("_before")
    return sized.withColumn("_own", own).join(F.broadcast(parts(F.sum("_size"))), "_part").withColumn("_kept", before < room).drop("_own", "_before", "_part")


class TelemetryStore:
    """Records by batch, with the outcome of every line and the size so far.

    A batch only writes folders of its own, the size last, and reads one row of the batch before; one that runs again overwrites what it
    left, so each line counts once.  ``known`` says whether a line's ``node_id`` may report.
    """

    RECORD = "id bigint, node_id bigint, install_id string, schema_version int, event_millis bigint, fields string"

    def __init__(self, spark: SparkSession, path: str, cap_bytes: int, known: Callable[[], Column]):
        self.spark, self.path, self.cap_bytes, self.known = spark, path.rstrip("/"), cap_bytes, known
        self.sizes = VersionedTable(spark, f"{self.path}/sizes", "bytes bigint, records bigint")

    def size(self, before: int | None = None) -> tuple[int, int]:
        """Bytes and records that are stored."""
        return tuple(self.sizes.read(before).first() or (0, 0))

    def _read(self, name: str, schema: str) -> DataFrame:
        there = [f"{self.path}/{name}/v{v}" for v in self.sizes.versions()]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self._read("records", self.RECORD)

    def outcomes(self) -> DataFrame:
        return self._read("outcomes", "id bigint, outcome string")

    def step(self, lines: DataFrame, number: int) -> None:
        """Store a batch of lines (``id, node_id, value``) in order of ``id``."""
        used, count = self.size(before=number)
        judged = telemetry(lines, self.known(), keep=("id",))
        size = F.when(F.col("outcome") == "ok", F.octet_length("fields")).otherwise(0)
        out = settled(stored(judged, self.cap_bytes - used, size, "id"))
        ok = out.where("outcome = 'ok' AND _kept")
        fields = [c.split(" ")[0] for c in self.RECORD.split(", ")]
        ok.select(*fields).write.mode("overwrite").parquet(f"{self.path}/records/v{number}")
        outcome = F.when((F.col("outcome") == "ok") & ~F.col("_kept"), "full").otherwise(F.col("outcome"))
        out.select("id", outcome.alias("outcome")).write.mode("overwrite").parquet(f"{self.path}/outcomes/v{number}")
        total = ok.agg((F.coalesce(F.sum("_size"), F.lit(0)) + used).alias("bytes"), (F.count("*") + count).alias("records"))
        self.sizes.write(total, number)
        release(out)

    def fed_by(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        return lines.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
