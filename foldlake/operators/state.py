"""State of a folder table: latest and as-of versions, change feeds, diffs, upserts, tombstones, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.session import settled

#: Days a tombstone is kept.
TOMBSTONE_DAYS = 90
SIGNATURE = ("kind", "mode", "mtime_ns", "size", "inode")


def latest(feed: DataFrame, key: str | list[str] = "path", order: str = "seq") -> DataFrame:
    """The row of the highest ``order`` per key: one partial aggregate, no sort."""
    keys = [key] if isinstance(key, str) else key
    return feed.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in feed.columns if c not in keys]), F.col(order)).alias("_v")).select(*keys, "_v.*").select(*feed.columns)


def as_of(feed: DataFrame, seq: int | None = None, before: Column | None = None) -> DataFrame:
    """Latest rows among those up to ``seq`` or for which ``before`` holds; the predicate reaches the scan."""
    return latest(feed.where(before if before is not None else F.col("seq") <= seq))


def since(feed: DataFrame, cursor: int) -> DataFrame:
    """Incremental scan: versions after a cursor, in sequence order."""
    return feed.where(F.col("seq") > cursor).orderBy("seq")


def live(manifests: DataFrame) -> DataFrame:
    return manifests.where(~F.col("deleted"))


def stat_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose stat signature differs from the model's, is new or was tombstoned: ``path, reason``."""
    old = known.select("path", F.struct(*SIGNATURE).alias("_old"), "deleted")
    new = files.select("path", F.struct(*SIGNATURE).alias("_new")).join(old, "path", "left")
    reason = F.when(F.col("_old").isNull(), "new").when(F.col("deleted"), "restored").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return new.select("path", reason.alias("reason")).where("reason is not null")


def missing_files(known: DataFrame, files: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Live paths with no file in the listing; paths whose listing failed do not count as missing."""
    gone = live(known).select("path").join(files.select("path"), "path", "left_anti")
    return gone if failed is None else gone.join(failed.select("path"), "path", "left_anti")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two leaf sets (``path, manifest_id, deleted``); equal rows are left out."""
    b = before.select("path", F.col("manifest_id").alias("before_id"), F.col("deleted").alias("before_deleted"))
    a = after.select("path", F.col("manifest_id").alias("after_id"), F.col("deleted").alias("after_deleted"))
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("before_id").isNull(), "added").when(F.col("after_id").isNull(), "removed")
    change = change.when((F.col("before_id") != F.col("after_id")) | (F.col("before_deleted") != F.col("after_deleted")), "changed")
    return both.withColumn("change", change).where("change is not null").select("path", "change", "before_id", "after_id", "before_deleted", "after_deleted")


def rename_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Content that left one path and came to another without new chunks: ``content, from_path, to_path``.

    ``before`` and ``after`` have ``path, content``; several candidates are paired in path order.
    """
    rank = Window.partitionBy("content").orderBy("path")
    gone = before.join(after.select("path"), "path", "left_anti").withColumn("_n", F.row_number().over(rank)).select("content", "_n", F.col("path").alias("from_path"))
    come = after.join(before.select("path"), "path", "left_anti").withColumn("_n", F.row_number().over(rank)).select("content", "_n", F.col("path").alias("to_path"))
    return gone.join(come, ["content", "_n"]).select("content", "from_path", "to_path")


def upsert(current: DataFrame, batch: DataFrame, next_seq: int) -> DataFrame:
    """Put manifests: an unchanged identity refreshes metadata and keeps its sequence, anything else gets a new one.

    ``current``: ``path, manifest_id, seq, deleted``; ``batch``: ``path, manifest_id`` (one row a path).
    """
    old = current.select("path", F.col("manifest_id").alias("_id"), F.col("seq").alias("_seq"), "deleted")
    both = old.join(batch.select("path", F.col("manifest_id").alias("_new")), "path", "full_outer")
    fresh = F.col("_new").isNotNull() & (F.col("_id").isNull() | F.col("deleted") | (F.col("_id") != F.col("_new")))
    changed = numbered(both.where(fresh).select("path", F.col("_new").alias("manifest_id"), F.lit(False).alias("deleted")), ["path"], next_seq, "seq")
    same = both.where(~F.coalesce(fresh, F.lit(False))).select("path", F.coalesce("_new", "_id").alias("manifest_id"), "deleted", F.col("_seq").alias("seq"))
    action = lambda df, what: df.select("path", "manifest_id", "seq", "deleted", F.lit(what).alias("action"))
    return action(changed, "written").unionByName(action(same, "kept"))


def ranged(df: DataFrame, order: list[str]) -> tuple[DataFrame, Callable[[Column], DataFrame]]:
    """Rows settled in ranges of an order (``_part``), and a function for the running total of an aggregate before each range.

    The totals are one row a partition, which bounds what is put in one order and broadcast.
    """
    # settled: the ranges are drawn from a sample, and two runs of it could cut at different rows
    rows = settled(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))

    def before(total: Column) -> DataFrame:
        sums = rows.groupBy("_part").agg(total.alias("_n"))
        return sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))

    return rows, before


def numbered(df: DataFrame, order: list[str], first: int, name: str) -> DataFrame:
    """Gapless numbers in a total order without a single sorted partition.

    Rows are range-partitioned by ``order``; each partition numbers its own rows, after the counts of those before.
    """
    rows, before = ranged(df, order)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("bigint")
    return rows.withColumn("_own", own).join(F.broadcast(before(F.count("*"))), "_part").withColumn(name, F.col("_own") + F.col("_before") + (first - 1)).drop("_part", "_own", "_before")


def tombstone(current: DataFrame, gone: DataFrame, now_ms: int, strict: bool = False) -> DataFrame:
    """Soft deletes: the content id stays, the expiry is set; a tombstone that is there stays as it is.

    With ``strict`` an unknown path fails the job; ``unknown_paths`` lists them.
    """
    out = current.join(gone.select("path", F.lit(True).alias("_gone")), "path", "full_outer" if strict else "left")
    if strict:
        known = F.when(F.col("deleted").isNotNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unknown path: "), F.col("path"))))
        out = out.withColumn("path", known)
    fresh = F.coalesce("_gone", F.lit(False)) & ~F.col("deleted")
    return out.select("path", "manifest_id", "seq", (F.col("deleted") | fresh).alias("deleted"), F.when(fresh, F.lit(now_ms + TOMBSTONE_DAYS * 86_400_000)).alias("expires_ms"))


def unknown_paths(current: DataFrame, gone: DataFrame) -> DataFrame:
    return gone.select("path").distinct().join(current.select("path"), "path", "left_anti")


def stat(manifests: DataFrame, path: str) -> DataFrame:
    """The stat signature of one path, without its chunks: filter and columns reach the scan."""
    return manifests.where(F.col("path") == path).select("path", *SIGNATURE, "deleted")


def sweep_tombstones(manifests: DataFrame, now_ms: int, safe_seq: int) -> DataFrame:
    """Rows that stay: live ones and tombstones that are not expired or above the sequence all peers have confirmed."""
    return manifests.where(~(F.col("deleted") & (F.col("expires_ms") <= now_ms) & (F.col("seq") <= safe_seq)))


def set_minus(a: Column, b: Column) -> Column:
    """Order-preserving array difference that keeps repeated elements."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """A page of a listing: the first ``limit`` keys after one."""
    page = rows if after is None else rows.where(F.col(key) > after)
    return page.orderBy(key).limit(limit)


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch`` number of every row when cut into batches of ``size`` in a total order."""
    return numbered(rows, order, 0, "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def offsets(chunks: DataFrame) -> DataFrame:
    """Byte offset of every chunk in its content: the running length of those before."""
    before = Window.partitionBy("manifest_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def summary(manifests: DataFrame) -> DataFrame:
    """High-water mark (0 when empty) and counts of a folder."""
    return manifests.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("high_water"), F.count("*").alias("paths"), F.count(F.when(~F.col("deleted"), 1)).alias("live_paths"))


def verified(manifests: DataFrame, contents: DataFrame) -> DataFrame:
    """Point reads with an integrity check: ``path, manifest_id, intact`` where ``contents`` has the rehashed ``computed_id``."""
    return manifests.join(contents.select("path", "computed_id"), "path", "left").select("path", "manifest_id", F.col("manifest_id").eqNullSafe(F.col("computed_id")).alias("intact"))
