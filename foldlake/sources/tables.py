"""Readers of Parquet tables and the folder relations derived from them.

A folder table is an append-only feed of file versions.  The relations below stand for the tables a node keeps; every
operator takes DataFrames of their shape, so other feeds can be used in place of ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOTS, SNAPSHOT_DAYS = 4, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File versions: ``seq, path, author, authored_ms, ts, deleted, c, manifest_id``."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    path = F.concat(F.lit("u"), F.col("user_id"), F.lit("/f"), F.col("event_id") % 7, F.lit(".txt"))
    c = F.col("event_id") % 11
    return e.select(
        F.col("event_id").alias("seq"), path.alias("path"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("author"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("authored_ms"), "ts", (F.col("event_type") == "error").alias("deleted"),
        c.alias("c"), F.sha2(F.concat(path, F.lit(":"), c).cast("binary"), 256).alias("manifest_id"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state: the latest version of every path."""
    from foldlake.operators.state import latest

    return latest(feed(spark, sf_dir)).select("path", "manifest_id", "c", "seq", "author", "authored_ms", "deleted")


def manifest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lists by content: ``manifest_id, ord, chunk_id, length``."""
    m = feed(spark, sf_dir).select("manifest_id", "c").distinct()
    m = m.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") % 3)))
    k = F.col("c") + F.col("ord")
    chunk = F.sha2(F.concat(F.lit("k"), k, F.lit("/"), F.substring("manifest_id", 1, 4)).cast("binary"), 256)
    return m.select("manifest_id", "ord", chunk.alias("chunk_id"), (100 * (k + 1)).alias("length"))


def snapshot_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the snapshots: ``snap_seq, path, manifest_id, deleted``."""
    f = feed(spark, sf_dir).select("seq", "path", "manifest_id", "deleted", "ts")
    day = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / (86400 * SNAPSHOT_DAYS))
    first = F.greatest(F.lit(1), day + 1).cast("int")
    # latest per path and period, carried on to the later snapshots: each version is expanded once, not scanned once a snapshot
    best = f.withColumn("snap", first).where(F.col("snap") <= SNAPSHOTS).groupBy("path", "snap").agg(F.max_by(F.struct("seq", "manifest_id", "deleted"), "seq").alias("v"))
    each = best.withColumn("snap_seq", F.explode(F.sequence(F.col("snap"), F.lit(SNAPSHOTS))))
    last = each.groupBy("path", "snap_seq").agg(F.max_by("v", F.col("v.seq")).alias("v"))
    return last.select(F.col("snap_seq").cast("bigint").alias("snap_seq"), "path", F.col("v.manifest_id").alias("manifest_id"), F.col("v.deleted").alias("deleted"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers: ``snap_seq, root_hash, parent_seq, manifest_n``; the root is the ordered Merkle root."""
    from foldlake.operators.snapshots import headers

    return headers(snapshot_manifests(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk index: ``chunk_id, plaintext_length, last_seen_ms, blob_id``."""
    at = F.col("length") + 1000 * F.col("ord")
    return manifest_chunks(spark, sf_dir).groupBy("chunk_id").agg(F.any_value("length").alias("plaintext_length"), F.max(at).alias("last_seen_ms"), (F.floor(F.min(at) / 100) % 20).alias("blob_id"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every peer has acknowledged: ``peer_id, epoch, high_water``."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("user_id") % 20).alias("p"), "event_id").where("p <> 19")
    return e.groupBy("p").agg(F.max("event_id").alias("high_water")).select(F.concat(F.lit("p"), "p").alias("peer_id"), F.when(F.col("p") == 3, 2).otherwise(1).cast("bigint").alias("epoch"), "high_water")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster entries: ``node_id, added_by, role (0 reader, 1 writer), sig_ok``; node 1 is the founder."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("k"))
    return s.select(F.col("k").alias("node_id"), F.greatest(F.floor(F.col("k") / 2), F.lit(1)).alias("added_by"), F.when(F.col("k") % 5 == 0, 0).otherwise(1).alias("role"), (F.col("k") % 17 != 0).alias("sig_ok"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of a file tree: ``path, kind, mode, mtime_ns, size, inode`` for a part of the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("size")).where("doc_id % 9 <> 4")
    return d.select(F.concat("source", F.lit("/d"), "doc_id").alias("path"), F.lit("regular").alias("kind"), (F.when(F.col("doc_id") % 5 == 0, 493).otherwise(420)).alias("mode"), (F.col("doc_id") * 1_000_003).alias("mtime_ns"), (F.col("size") + F.when(F.col("doc_id") % 6 == 1, 1).otherwise(0)).alias("size"), F.col("doc_id").alias("inode"))


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model holds of the same tree: the stat signature and whether it is tombstoned."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("size")).where("doc_id % 8 <> 3")
    return d.select(F.concat("source", F.lit("/d"), "doc_id").alias("path"), F.lit("regular").alias("kind"), (F.when(F.col("doc_id") % 5 == 0, 493).otherwise(420)).alias("mode"), (F.col("doc_id") * 1_000_003).alias("mtime_ns"), "size", F.col("doc_id").alias("inode"), (F.col("doc_id") % 10 == 7).alias("deleted"))


__all__ = ["chunks", "feed", "files", "known_files", "manifest_chunks", "manifests", "members", "receipts", "snapshot_manifests", "snapshots", "table"]
