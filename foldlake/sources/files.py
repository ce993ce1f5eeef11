"""Files by Spark's own source, event masks, path rules, blob stores; ``trees`` is the source with modes, links and inodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of POSIX file modes and of the event mask.
S_IFMT, S_IFREG, S_IFDIR, S_IFLNK = 0o170000, 0o100000, 0o040000, 0o120000
CREATE, WRITE, REMOVE, RENAME, CHMOD = 1, 2, 4, 8, 16
STAGING = ".staging"


def tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below a root: ``path`` (relative), ``mtime`` and ``size``, and ``content`` if wanted.

    A root that is not there is an error, so an outage cannot look like deletions; the staging folder is passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", False).load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index("path", base, -1)
    out = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    return out.where(~F.col("path").startswith(STAGING + "/"))


def events(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """A stream of files that appear below a root: ``path, mtime, size, op``.  Modes and inodes are not in Spark's source."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.lit(CREATE).alias("op"))


def kind(mode: Column) -> Column:
    """``symlink``, ``dir`` or ``regular`` by mode bits; null for anything else, which a scan drops."""
    bits = mode.bitwiseAND(F.lit(S_IFMT))
    return F.when(bits == S_IFLNK, "symlink").when(bits == S_IFDIR, "dir").when(bits == S_IFREG, "regular")


def op_mask(created: Column, written: Column, removed: Column, renamed: Column, modes: Column) -> Column:
    """Event flags as one number."""
    out = F.lit(0)
    for flag, bit in ((created, CREATE), (written, WRITE), (removed, REMOVE), (renamed, RENAME), (modes, CHMOD)):
        out = out.bitwiseOR(F.when(flag, bit).otherwise(0))
    return out


def path_state(path: Column, kind: Column, target: Column, chunks: Column, least: Column) -> Column:
    """``ok`` or the first rule a manifest breaks; ``chunks`` is their number and ``least`` the shortest one's length."""
    from foldlake.functions.columns import clean_path

    bad = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    has = F.coalesce(target, F.lit("")) != ""
    rules = (
        F.when(F.coalesce(path, F.lit("")) == "", "empty path").when(path.startswith("/"), "absolute path").when(bad, "bad segment")
        .when((kind == "symlink") & ~has, "no target").when((kind == "symlink") & (chunks > 0), "symlink with chunks")
        .when((kind == "symlink") & target.startswith("/"), "target escapes").when((kind == "symlink") & clean_path(target).rlike(r"^\.\.(/|$)"), "target escapes")
        .when((kind == "dir") & ((chunks > 0) | has), "directory with content").when((kind == "regular") & has, "file with target")
        .when(~kind.isin("symlink", "dir", "regular") | kind.isNull(), "unknown kind").when((chunks > 0) & (least <= 0), "chunk length")
    )
    return rules.otherwise("ok")


def destination(root: Column, path: Column) -> Column:
    """Where a path goes below a root; null if it would leave it."""
    segments = F.split(path, "/")
    ok = (path != "") & ~path.startswith("/") & ~F.exists(segments, lambda s: s.isin("", ".", ".."))
    return F.when(ok, F.concat(root, F.lit("/"), path))


class BlobStore:
    """Blobs (``id`` in hex, ``data``, ``mod_ms``); a later put of an id replaces the blob.

    Every put and every delete is one numbered folder ``n=<k>`` of rows in order of ids, with the ids' first byte as ``shard``; it
    counts once Spark has committed it, so a run that ends in between changes nothing.  Of the rows of an id the last number counts.  One writer at
    a time.
    """

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("mod_ms", T.LongType()), T.StructField("gone", T.BooleanType())])
    placed = T.StructType([*schema.fields, T.StructField("shard", T.StringType()), T.StructField("n", T.LongType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, pattern: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/n=*{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().toString().split("/n=")[-1].split("/")[0]) for f in found)

    def _rows(self, shards: list[str] | None = None) -> DataFrame:
        complete = self._folders("/_SUCCESS")
        if not complete:
            return self.spark.createDataFrame([], self.placed)
        rows = self.spark.read.schema(self.placed).option("basePath", self.path).parquet(*[f"{self.path}/n={k}" for k in complete])
        return rows if shards is None else rows.where(F.col("shard").isin(shards))

    def _write(self, rows: DataFrame) -> None:
        number = max(self._folders(""), default=0) + 1
        # in order of ids, so that files and row groups are passed over by their least and largest shard and id
        rows.withColumn("shard", F.concat(F.lit("s"), F.substring("id", 1, 2))).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/n={number}")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Ids that are there and the number of their last put; contents are not read."""
        last = rows.groupBy("id").agg(F.max(F.struct("n", "gone")).alias("_l"))
        return last.where(~F.col("_l.gone")).select("id", F.col("_l.n").alias("n"))

    def _shards(self, ids: DataFrame) -> list[str]:
        return [r[0] for r in ids.select(F.concat(F.lit("s"), F.substring("id", 1, 2))).distinct().collect()]  # 256 at most

    def all(self) -> DataFrame:
        rows = self._rows()
        return rows.join(self._live(rows), ["id", "n"], "left_semi").select("id", "data", "mod_ms")

    def put(self, blobs: DataFrame) -> None:
        """Of several blobs of an id in one put the smallest content counts."""
        self._write(blobs.groupBy("id").agg(F.min(F.struct("data", "mod_ms")).alias("_b")).select("id", "_b.*", F.lit(False).alias("gone")))

    def delete(self, ids: DataFrame) -> None:
        """Ids that are not there are passed over."""
        known = self._live(self._rows(self._shards(ids))).join(ids.select("id"), "id", "left_semi")
        self._write(known.select("id", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("long").alias("mod_ms"), F.lit(True).alias("gone")))

    def missing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self._live(self._rows(self._shards(ids))), "id", "left_anti")

    def get(self, ids: DataFrame) -> DataFrame:
        """Blobs of some ids; of the files only row groups with their first bytes are read."""
        rows = self._rows(self._shards(ids)).join(ids.select("id"), "id", "left_semi")
        return rows.join(self._live(rows), ["id", "n"], "left_semi").select("id", "data", "mod_ms")

    def page(self, after: str, limit: int) -> DataFrame:
        """``id, mod_ms`` of the first blobs behind an id, in order."""
        rows = self._rows().where(F.col("id") > after)
        return rows.join(self._live(rows), ["id", "n"], "left_semi").select("id", "mod_ms").orderBy("id").limit(limit)

    def compact(self) -> None:
        """Put all blobs once more, then drop the folders before, the oldest first: a delete outlives every put that it hides."""
        before = self._folders("")
        self._write(self.all().withColumn("gone", F.lit(False)))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for k in before:
            at = hadoop.Path(f"{self.path}/n={k}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
