"""Merkle trees over sorted leaves, without sorting them in one place: roots, stored trees, cuts by changes, diffs by descent.

An odd node is carried up unchanged, so aligned blocks of 2^k leaves reduce on their own: leaves are numbered in path
order, each block becomes a node, and the nodes are reduced the same way until one is left.  A tree of 2^40 leaves needs five
rounds.  A stored tree keeps the leaves with their numbers and the nodes of every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.functions.encoding import sized
from foldlake.functions.expressions import let
from foldlake.operators.state import diff, numbered
from foldlake.session import settled

LEAF_DOMAIN, NODE_DOMAIN, EMPTY_DOMAIN = b"foldlake/leaf/v1\0", b"foldlake/node/v1\0", b"foldlake/empty/v1\0"
#: A block has 2^BLOCK_BITS leaves or nodes.
BLOCK_BITS = 8


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def leaf_hash(path: str, manifest_id: bytes, deleted: bool, digest: Callable[[bytes], bytes] = sha, domain: bytes = LEAF_DOMAIN) -> bytes:
    return digest(domain + sized(path.encode()) + manifest_id + bytes([bool(deleted)]))


def reduce_level(hashes: list[bytes], digest: Callable[[bytes], bytes] = sha, domain: bytes = NODE_DOMAIN) -> bytes:
    """Root of consecutive nodes."""
    while len(hashes) > 1:
        hashes = [digest(domain + hashes[i] + hashes[i + 1]) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


def empty_root(digest: Callable[[bytes], bytes] = sha, domain: bytes = EMPTY_DOMAIN) -> bytes:
    return digest(domain)


def varint(n: Column) -> Column:
    """Unsigned variable-length bytes of a number below 2^28."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    part = lambda k: F.shiftright(n, 7 * k)
    more = lambda k: byte(part(k) % 128 + 128)
    out = F.concat(more(0), more(1), more(2), byte(part(3)))
    for k in (2, 1, 0):
        out = F.when(n < 1 << 7 * (k + 1), F.concat(*map(more, range(k)), byte(part(k)))).otherwise(out)
    return out


def leaf_digest(path: Column, manifest_id: Column, deleted: Column) -> Column:
    """``leaf_hash`` with SHA-256 as an expression; ``manifest_id`` in hex."""
    body = F.encode(path, "UTF-8")
    parts = (F.lit(LEAF_DOMAIN), varint(F.octet_length(body).cast("bigint")), body, F.unhex(manifest_id), F.when(deleted, F.lit(b"\1")).otherwise(F.lit(b"\0")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def halved(hashes: Column) -> Column:
    """Neighbours of an array hashed in pairs; an odd last one is carried up."""
    pair = lambda i: F.unhex(F.sha2(F.concat(F.lit(NODE_DOMAIN), F.get(hashes, i), F.get(hashes, i + 1)), 256))
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(2)), lambda i: F.when(i + 1 < F.size(hashes), pair(i)).otherwise(F.get(hashes, i)))


def block_root(hashes: Column, bits: int) -> Column:
    """Root of up to 2^bits hashes."""
    return let(halved(hashes), lambda h: block_root(h, bits - 1)) if bits else F.get(hashes, F.lit(0))


def raised(level: DataFrame, digest: Callable[[bytes], bytes] = sha) -> DataFrame:
    """Nodes (``g, i, h``) of the blocks of a level."""
    blocks = level.select("g", F.shiftright("i", BLOCK_BITS).alias("b"), "i", "h")
    if digest is sha:
        own = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        return blocks.groupBy("g", "b").agg(own.alias("_h")).select("g", F.col("b").alias("i"), block_root(F.col("_h"), BLOCK_BITS).alias("h"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "i": [int(pdf["b"].iloc[0])], "h": [reduce_level([bytes(x) for x in pdf["h"]], digest)]})

    return blocks.groupBy("g", "b").applyInPandas(block, f"g {level.schema['g'].dataType.simpleString()}, i long, h binary")


def height(n: int) -> int:
    """Rounds of a tree of n leaves; one at least."""
    return max(1, -(-(max(n, 1) - 1).bit_length() // BLOCK_BITS))


def placed(leaves: DataFrame, by: str | None, digest: Callable[[bytes], bytes]) -> tuple[DataFrame, DataFrame]:
    """Leaves with group ``g``, number ``i`` in path order and hash ``h``, and one row a group: ``g, leaves``."""

    @F.pandas_udf("binary")
    def hashed(path: pd.Series, manifest_id: pd.Series, deleted: pd.Series) -> pd.Series:
        return pd.Series([leaf_hash(p, bytes.fromhex(m), d, digest) for p, m, d in zip(path, manifest_id, deleted)])

    group = F.lit(0).cast("bigint") if by is None else F.col(by)
    ordered = numbered(leaves.select(group.alias("g"), "path", "manifest_id", "deleted"), ["g", "path"], 0, "i")
    columns = [F.col(c) for c in ("path", "manifest_id", "deleted")]
    first = settled(ordered.groupBy("g").agg(F.min("i").alias("_first"), F.count("*").alias("leaves")))
    own = ordered.join(first.select("g", "_first"), "g").select("g", (F.col("i") - F.col("_first")).alias("i"), *columns, (leaf_digest if digest is sha else hashed)(*columns).alias("h"))
    return own, first.select("g", "leaves")


def roots(leaves: DataFrame, by: str | None = None, digest: Callable[[bytes], bytes] = sha) -> DataFrame:
    """``root`` (hex) and ``leaves`` of each group; input ``path, manifest_id`` (hex), ``deleted``, one leaf a path, tombstones included.

    Other digests than SHA-256 hash in Python.
    """
    level, counts = placed(leaves, by, digest)
    for _ in range(height(counts.agg(F.max("leaves")).first()[0] or 1)):
        level = raised(level.select("g", "i", "h"), digest)
    return level.join(counts, "g").select(F.col("g").alias(by or "_g"), F.lower(F.hex("h")).alias("root"), "leaves")


def root(leaves: DataFrame, digest: Callable[[bytes], bytes] = sha) -> DataFrame:
    """One row ``root, leaves``; without leaves the root of nothing."""
    one = roots(leaves, None, digest).agg(F.first("root").alias("root"), F.first("leaves").alias("leaves"))
    return one.select(F.coalesce("root", F.lit(empty_root(digest).hex())).alias("root"), F.coalesce("leaves", F.lit(0)).cast("bigint").alias("leaves"))


@dataclass
class Tree:
    """A stored tree of each group: leaves ``g, i, path, manifest_id, deleted, h`` and the nodes ``g, i, h`` of every level, the blocks of leaves first."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        return self.levels[-1].select("g", F.lower(F.hex("h")).alias("root"))

    def of(self, g: object) -> Tree:
        own = F.col("g") == F.lit(g)
        return Tree(self.leaves.where(own), [x.where(own) for x in self.levels])


def planted(leaves: DataFrame, by: str | None = None) -> Tree:
    """The tree of every group of leaves, as tables."""
    own, counts = placed(leaves, by, sha)
    own, levels = settled(own), []
    for _ in range(height(counts.agg(F.max("leaves")).first()[0] or 1)):
        levels.append(settled(raised((levels[-1] if levels else own).select("g", "i", "h"))))
    return Tree(own, levels)


def grown(tree: Tree, changes: DataFrame) -> tuple[Tree, list[int]]:
    """The tree of one group after upserts (``path, manifest_id, deleted``), and how many blocks of each level were hashed again.

    k changed leaves touch k blocks of a level at most.  Leaves are hashed by their place, so a path that is new moves all leaves behind it,
    and their blocks are hashed again too.
    """
    old, changes = tree.leaves, changes.select("path", "manifest_id", "deleted", leaf_digest(F.col("path"), F.col("manifest_id"), F.col("deleted")).alias("_h"))
    both = settled(changes.join(old.select("path", "i", "h"), "path", "left"))
    moved = both.where((F.col("i").isNotNull()) & (F.col("h") != F.col("_h"))).drop("h")
    g = old.select("g").first()
    g = g["g"] if g else 0
    least, size = both.where("i is null").agg(F.min("path"), F.count("*")).first()
    n = old.count()
    first = n if least is None else old.where(F.col("path") < least).count()
    told = moved.select("path", F.col("manifest_id").alias("_m"), F.col("deleted").alias("_d"), "_h")
    now = old.join(told, "path", "left").select("path", "i", *(F.coalesce(a, b).alias(b) for a, b in (("_m", "manifest_id"), ("_d", "deleted"), ("_h", "h"))))
    stay = now.where(F.col("i") < first)
    if least is not None:
        new = both.where("i is null").select("path", "manifest_id", "deleted", F.col("_h").alias("h"))
        stay = stay.unionByName(numbered(now.where(F.col("i") >= first).drop("i").unionByName(new), ["path"], first, "i"))
    leaves = settled(stay.select(F.lit(g).cast(old.schema["g"].dataType).alias("g"), "i", "path", "manifest_id", "deleted", "h"))
    touched = moved.where(F.col("i") < first).select(F.shiftright("i", BLOCK_BITS).alias("i")).unionByName(leaves.where(F.col("i") >= first).select(F.shiftright("i", BLOCK_BITS).alias("i"))).distinct()
    levels, hashed = [], []
    for k in range(height(n + size)):
        touched = settled(touched)
        below = (levels[-1] if levels else leaves).select("g", "i", "h")
        again = settled(raised(below.withColumn("_b", F.shiftright("i", BLOCK_BITS)).join(touched.select(F.col("i").alias("_b")), "_b", "left_semi").drop("_b")))
        kept = tree.levels[k].join(touched, "i", "left_anti").select("g", "i", "h") if k < len(tree.levels) else again.limit(0)
        levels.append(settled(kept.unionByName(again)))
        hashed.append(again.count())
        touched = touched.select(F.shiftright("i", BLOCK_BITS).alias("i")).distinct()
    return Tree(leaves, levels), hashed


def unequal(before: Tree, after: Tree) -> tuple[DataFrame, DataFrame]:
    """Leaves of the blocks in which two trees of a group each differ: level by level, below unequal nodes only.

    A block that is equal in both holds the same leaves on both sides, so what is left out has not changed.
    """
    top = min(len(before.levels), len(after.levels))
    a, b = before.levels[top - 1].select("i", "h"), after.levels[top - 1].select("i", "h")
    for k in range(top - 1, -1, -1):
        open_ = settled(a.select("i", F.col("h").alias("_a")).join(b.select("i", F.col("h").alias("_b")), "i", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.col("i").alias("_b")))
        blocks = F.broadcast(open_) if open_.count() <= BROADCAST_BLOCKS else open_
        below = [t.levels[k - 1].select("i", "h") if k else t.leaves for t in (before, after)]
        a, b = (x.withColumn("_b", F.shiftright("i", BLOCK_BITS)).join(blocks, "_b", "left_semi").drop("_b") for x in below)
    return a, b


#: Blocks (a number each) up to which their list is broadcast.
BROADCAST_BLOCKS = 1_000_000


def changed(before: Tree, after: Tree) -> DataFrame:
    """``state.diff`` of the leaves of two trees, of which only unequal blocks are read."""
    return diff(*(x.select("path", "manifest_id", "deleted") for x in unequal(before, after)))
