"""Reachability, storage accounting, garbage collection, quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRACE_MS = 3_600_000


def reachable_manifests(current: DataFrame, leaves: DataFrame) -> DataFrame:
    """Distinct ids of live current manifests and live snapshot leaves."""
    live = lambda df: df.where(~F.col("deleted")).select("manifest_id")
    return live(current).union(live(leaves)).distinct()


def reachable_chunks(current: DataFrame, leaves: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    return manifest_chunks.join(reachable_manifests(current, leaves), "manifest_id", "left_semi").select("chunk_id").distinct()


def logical_bytes(manifests: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """Bytes of the distinct chunks of some manifests: each chunk counts once."""
    once = manifest_chunks.join(manifests.select("manifest_id").distinct(), "manifest_id", "left_semi").groupBy("chunk_id").agg(F.any_value("length").alias("length"))
    return once.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("chunks"))


def superseded(current: DataFrame, leaves: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """Chunks that snapshots still hold and the current state no longer does."""
    live = lambda df: df.where(~F.col("deleted")).select("manifest_id").distinct()
    held = manifest_chunks.join(live(leaves), "manifest_id", "left_semi").select("chunk_id").distinct()
    return held.join(manifest_chunks.join(live(current), "manifest_id", "left_semi").select("chunk_id"), "chunk_id", "left_anti")


def victims(chunks: DataFrame, reachable: DataFrame, cutoff_ms: int) -> DataFrame:
    """Mark and sweep: chunks nobody reaches, last seen strictly before the cutoff."""
    return chunks.where(F.col("last_seen_ms") < cutoff_ms).join(reachable, "chunk_id", "left_anti")


def sweep(chunks: DataFrame, reachable: DataFrame, cutoff_ms: int) -> DataFrame:
    """The chunk index after a collection; the age is tested again on deletion."""
    return chunks.join(victims(chunks, reachable, cutoff_ms).select("chunk_id"), "chunk_id", "left_anti")


def dead_containers(containers: DataFrame, chunks: DataFrame, key: str = "blob_id") -> DataFrame:
    """Pack files or clone objects that no chunk lies in (null keys in the index match nothing)."""
    return containers.join(chunks.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def missing_chunks(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct wanted chunks that are not there."""
    return wanted.select("chunk_id").distinct().join(present.select("chunk_id"), "chunk_id", "left_anti")


def held_by_nobody(blobs: DataFrame, needed: DataFrame, cutoff_ms: int) -> DataFrame:
    """Stored blobs that are not needed and older than the grace period."""
    return blobs.where(F.col("mod_ms") < cutoff_ms).join(needed.select("id"), "id", "left_anti")


def superseded_by_batch(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks that applying a batch drops: each path's prior chunks minus its new ones (``path, chunk_id``)."""
    return prior.select("path", "chunk_id").join(new.select("path", "chunk_id"), ["path", "chunk_id"], "left_anti").select("chunk_id").distinct()


def sharing(leaves: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """Per snapshot: bytes as if stored alone, and bytes that no earlier snapshot had."""
    each = leaves.where(~F.col("deleted")).select("snap_seq", "manifest_id").distinct().join(manifest_chunks, "manifest_id").groupBy("snap_seq", "chunk_id").agg(F.any_value("length").alias("length"))
    first = each.groupBy("chunk_id").agg(F.min("snap_seq").alias("snap_seq"), F.any_value("length").alias("length")).groupBy("snap_seq").agg(F.sum("length").alias("new_bytes"))
    return each.groupBy("snap_seq").agg(F.sum("length").alias("bytes")).join(first, "snap_seq", "left").select("snap_seq", "bytes", F.coalesce("new_bytes", F.lit(0)).alias("new_bytes"))


def usage_after_forgetting(current: DataFrame, snapshots: DataFrame, leaves: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """Reachable bytes once the oldest k snapshots are forgotten, for every k (0 = none): ``forgotten, used``.

    Forgetting is by root, so a snapshot dies when the earliest of its root does; a chunk dies with the last
    snapshot that holds it, or never if the current state does.
    """
    death = snapshots.groupBy("root_hash").agg(F.min("snap_seq").alias("death")).join(snapshots, "root_hash").select("snap_seq", "death")
    held = leaves.where(~F.col("deleted")).join(death, "snap_seq").groupBy("manifest_id").agg(F.max("death").alias("death"))
    now = current.where(~F.col("deleted")).select("manifest_id", F.lit(2**62).alias("death"))
    by_manifest = held.union(now).groupBy("manifest_id").agg(F.max("death").alias("death"))
    by_chunk = manifest_chunks.join(by_manifest, "manifest_id").groupBy("chunk_id").agg(F.max("death").alias("death"), F.any_value("length").alias("length"))
    dying = by_chunk.groupBy("death").agg(F.sum("length").alias("bytes"))
    steps = snapshots.select(F.col("snap_seq").alias("death")).union(snapshots.sparkSession.range(1).select(F.lit(0).cast("bigint")))
    # what dies after step k: a running sum from the end, over one row a snapshot
    both = steps.distinct().withColumn("_step", F.lit(True)).join(dying, "death", "full_outer")
    later = Window.orderBy(F.desc("death")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("used", F.coalesce(F.sum("bytes").over(later), F.lit(0))).where("_step").select(F.col("death").alias("forgotten"), "used")


def prune_to_fit(usage: DataFrame, quota: int) -> DataFrame:
    """``forgotten, used, fits``: the fewest oldest snapshots to forget, or all of them when the current state alone exceeds the quota."""
    if quota <= 0:
        return usage.where("forgotten = 0").select("forgotten", "used", F.lit(True).alias("fits"))
    fit = F.min(F.when(F.col("used") <= quota, F.struct("forgotten", "used")))
    out = usage.agg(fit.alias("_f"), F.max(F.struct("forgotten", "used")).alias("_l"))
    best = F.coalesce("_f", "_l")
    return out.select(best["forgotten"].alias("forgotten"), best["used"].alias("used"), F.col("_f").isNotNull().alias("fits"))
