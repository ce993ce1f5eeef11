"""Snapshots: set roots, parents, cuts, forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlake.operators import merkle


def headers(leaves: DataFrame) -> DataFrame:
    """Headers of snapshots by number: ``snap_seq, root_hash`` (the ordered Merkle root), ``parent_seq, manifest_n``."""
    parent = F.when(F.col("snap_seq") > 1, F.col("snap_seq") - 1)
    return merkle.roots(leaves, "snap_seq").select("snap_seq", F.col("root").alias("root_hash"), parent.alias("parent_seq"), F.col("leaves").alias("manifest_n"))


def with_parent(snapshots: DataFrame) -> DataFrame:
    """Headers with the parent's root (none for the first)."""
    parent = snapshots.select(F.col("snap_seq").alias("parent_seq"), F.col("root_hash").alias("parent_root"))
    return snapshots.join(parent, "parent_seq", "left").select("snap_seq", "root_hash", "parent_seq", "parent_root", "manifest_n")


def by_root(snapshots: DataFrame, root: str) -> DataFrame:
    """The most recent snapshot with a root."""
    return snapshots.where(F.col("root_hash") == root).orderBy(F.desc("snap_seq")).limit(1)


def cuts(headers: DataFrame) -> DataFrame:
    """Which cuts make a snapshot: a root equal to the one before makes none.  Headers are few, one per cut."""
    before = F.lag("root_hash").over(Window.orderBy("snap_seq"))
    return headers.select("snap_seq", "root_hash", (~F.col("root_hash").eqNullSafe(before)).alias("written"))


def forget(snapshots: DataFrame, leaves: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Headers and leaves without every snapshot of a root."""
    dead = snapshots.where(F.col("root_hash") == root).select("snap_seq")
    return snapshots.join(dead, "snap_seq", "left_anti"), leaves.join(dead, "snap_seq", "left_anti")


def cut(snapshots: DataFrame, leaves: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and leaves after a cut of the current rows: nothing changes when the latest root is theirs already.

    Leaves are appended: a table partitioned by ``snap_seq`` gets one partition more.
    """
    last = snapshots.agg(F.max(F.struct("snap_seq", "root_hash")).alias("_l")).select(F.coalesce("_l.snap_seq", F.lit(0)).alias("_seq"), F.col("_l.root_hash").alias("_root"))
    now = merkle.root(current).select(F.col("root").alias("root_hash"), F.col("leaves").alias("manifest_n"))
    new = now.join(F.broadcast(last)).where(~F.col("root_hash").eqNullSafe(F.col("_root")))
    header = new.select((F.col("_seq") + 1).cast("bigint").alias("snap_seq"), "root_hash", F.when(F.col("_seq") > 0, F.col("_seq")).cast("bigint").alias("parent_seq"), "manifest_n")
    added = current.join(F.broadcast(header.select("snap_seq"))).select("snap_seq", "path", "manifest_id", "deleted")
    return snapshots.unionByName(header), leaves.unionByName(added)


def get(snapshots: DataFrame, leaves: DataFrame, root: str) -> DataFrame:
    """The most recent snapshot of a root with its parent's root, one row a leaf."""
    head = by_root(with_parent(snapshots), root)
    return head.select("snap_seq", "root_hash", "parent_root").join(leaves, "snap_seq")


def diff_roots(snapshots: DataFrame, tree: merkle.Tree, before: str, after: str) -> DataFrame:
    """Changes between the snapshots of two roots, by descent through their trees (groups by ``snap_seq``); a root that is not there is an error."""
    seqs = []
    for root in (before, after):
        head = by_root(snapshots, root).first()
        if head is None:
            raise LookupError(f"no snapshot of root {root}")
        seqs.append(head["snap_seq"])
    return merkle.changed(*map(tree.of, seqs))


def cut_changes(snapshots: DataFrame, tree: merkle.Tree, changes: DataFrame) -> tuple[DataFrame, merkle.Tree]:
    """Headers and tree of a folder after a cut that hashes only the blocks of changed rows; no header is added if the latest root is theirs already."""
    tree, _ = merkle.grown(tree, changes)
    last = snapshots.agg(F.max(F.struct("snap_seq", "root_hash")).alias("_l")).select(F.coalesce("_l.snap_seq", F.lit(0)).alias("_seq"), F.col("_l.root_hash").alias("_root"))
    new = tree.roots().join(F.broadcast(last)).where(~F.col("root").eqNullSafe(F.col("_root"))).join(F.broadcast(tree.leaves.agg(F.count("*").alias("manifest_n"))))
    header = new.select((F.col("_seq") + 1).cast("bigint").alias("snap_seq"), F.col("root").alias("root_hash"), F.when(F.col("_seq") > 0, F.col("_seq")).cast("bigint").alias("parent_seq"), "manifest_n")
    return snapshots.unionByName(header), tree
