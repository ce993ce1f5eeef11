"""Chunk index, pack files, clones, holders, repair: what a node stores and how it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLONE, PACKED = "clone", "packed"


def insert_ignore(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and the rows of ``batch`` whose key is new; of several new rows of a key the least stays."""
    rest = [c for c in rows.columns if c not in keys]
    new = batch.join(rows.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return rows.unionByName(new.select(*keys, "_r.*").select(*rows.columns))


def pack(chunks: DataFrame, order: str, target: int) -> DataFrame:
    """``pack`` and ``pack_offset`` of every chunk: a pack file is closed before a chunk that would take it over ``target`` bytes.

    ``chunks``: ``stream``, the order, ``length`` and others.  Greedy packing is a fold; chunks of a stream pass through in
    sorted batches, so memory does not grow with a stream.  A chunk above the target has a file of its own.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema) + ", pack long, pack_offset long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, number, size = None, 0, 0
        for pdf in batches:
            packs, offsets = [], []
            for s, n in zip(pdf["stream"], pdf["length"]):
                if s != stream:
                    stream, number, size = s, 0, 0
                elif size and size + n > target:
                    number, size = number + 1, 0
                packs.append(number)
                offsets.append(size)
                size += n
            yield pdf.assign(pack=packs, pack_offset=offsets)

    return chunks.repartition("stream").sortWithinPartitions("stream", order).mapInPandas(fold, schema)


def ingest_clones(index: DataFrame, clones: DataFrame) -> DataFrame:
    """Upsert of clone-backed chunks (``chunk_id, object_id, offset, length, seen_ms``): known chunks are pointed to the clone.

    ``index``: ``chunk_id, backing, blob_id, object_id, offset, length, last_seen_ms``.
    """
    new = clones.select("chunk_id", F.struct(F.lit(CLONE).alias("backing"), F.lit(None).cast("bigint").alias("blob_id"), "object_id", "offset", "length", F.col("seen_ms").alias("last_seen_ms")).alias("_new"))
    old = index.select("chunk_id", F.struct("backing", "blob_id", "object_id", "offset", "length", "last_seen_ms").alias("_old"))
    return old.join(new, "chunk_id", "full_outer").select("chunk_id", F.coalesce("_new", "_old").alias("_r")).select("chunk_id", "_r.*")


def promote(index: DataFrame, placed: DataFrame) -> DataFrame:
    """Clone-backed chunks with a place (``chunk_id, pack, pack_offset``) become packed; missing or packed ones are passed over."""
    both = index.join(placed.select("chunk_id", "pack", "pack_offset"), "chunk_id", "left")
    moved = F.col("pack").isNotNull() & (F.col("backing") == CLONE)
    pick = lambda new, old: F.when(moved, new).otherwise(F.col(old)).alias(old)
    return both.select("chunk_id", pick(F.lit(PACKED), "backing"), pick(F.col("pack"), "blob_id"), pick(F.lit(None), "object_id"), pick(F.col("pack_offset"), "offset"), "length", "last_seen_ms")


def orphans(listing: DataFrame, objects: DataFrame) -> DataFrame:
    """Clone files (``path``) that no object names: what a crash between writing and indexing leaves."""
    return listing.where(F.col("path").endswith(".clone")).join(objects.select("path"), "path", "left_anti")


def repairs(manifests: DataFrame, files: DataFrame, manifest_chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Live files that are not there: ``path, bytes, repairable`` (all their chunks are)."""
    gone = manifests.where(~F.col("deleted")).join(files.select("path"), "path", "left_anti").select("path", "manifest_id")
    have = index.select("chunk_id", F.lit(True).alias("_have"))
    each = gone.join(manifest_chunks, "manifest_id").join(have, "chunk_id", "left")
    return each.groupBy("path").agg(F.sum("length").alias("bytes"), F.bool_and(F.col("_have").isNotNull()).alias("repairable"))


def needed(chunk_ids: DataFrame, catalog: Column, pointer: Column) -> DataFrame:
    """Blobs that a holder must keep: the live chunks, the catalog and the pointer (``id``)."""
    own = chunk_ids.sparkSession.range(1).select(F.explode(F.array(catalog, pointer)).alias("id"))
    return chunk_ids.select(F.col("chunk_id").alias("id")).union(own).distinct()


def holder_pushes(chunk_ids: DataFrame, catalog: Column, pointer: Column, held: DataFrame) -> DataFrame:
    """What brings a holder up to date, in order: absent chunks (1), the catalog if absent (2), the pointer always (3)."""
    one = chunk_ids.sparkSession.range(1)
    absent = chunk_ids.select(F.col("chunk_id").alias("id")).distinct().select(F.lit(1).alias("step"), "id").union(one.select(F.lit(2), catalog))
    return absent.join(held.select("id"), "id", "left_anti").select("step", "id").union(one.select(F.lit(3), pointer))


def total_length(chunks: Column) -> Column:
    """Bytes of an array of chunk references."""
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda t, c: t + c["length"])


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct keys with the place of their first appearance, in that order."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_at")).select(key, "_at.*").orderBy(*order)


def config_violations(folders: DataFrame) -> DataFrame:
    """Folders against the rule that what a holder keeps is encrypted."""
    return folders.where(F.col("holder") & ~F.col("encrypted"))


def configured(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """Folder configuration after changes (``folder_id, op, value, at``): added, removed, shared, keyed.

    The last ``add`` or ``remove`` says whether a folder is there, the last ``share`` names it to others, and the first
    ``key`` stays: a key that is set is never replaced.
    """
    of = lambda op: F.col("op").isin(*op)
    last = changes.groupBy("folder_id").agg(
        F.max_by("op", F.when(of(["add", "remove"]), F.col("at"))).alias("_there"), F.max_by("value", F.when(of(["share"]), F.col("at"))).alias("_share"), F.min_by("value", F.when(of(["key"]), F.col("at"))).alias("_key"),
    )
    both = folders.join(last, "folder_id", "full_outer")
    there = F.coalesce(F.col("_there") == "add", F.col("share_id").isNotNull())
    return both.where(there).select("folder_id", F.coalesce("_share", "share_id", "folder_id").alias("share_id"), F.coalesce("key", "_key").alias("key"))
