"""Bulk membership by a split-block Bloom filter kept as a table beside the ids.

An id has a block by one hash and one bit in each of the block's eight words by another, so a filter row is built by ``bit_or`` and
probed by one join on the block.  Words instead of ids are what such a join moves: some 16 bits for an id.  What the filter
does not know is not there; what it may know is confirmed against the ids, which pass by a list of those few probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block, of 64 bits each.
WORDS = 8
#: Blocks, and probes to be confirmed, up to which they are broadcast.
BROADCAST_ROWS = 200_000


def blocks_for(ids: int, bits: int = 16) -> int:
    """Blocks of a filter for so many ids of so many bits each."""
    return max(1, -(-ids * bits // (64 * WORDS)))


def block(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), id_), F.lit(blocks))


def masks(id_: Column) -> list[Column]:
    """One bit of each word: six bits of a second hash, and for the last ones of a third."""
    bit = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(2 + k // 5), id_), 12 * (k % 5)).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit(k)) for k in range(WORDS)]


def built(ids: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter of some ids: ``block`` and its words, as an array; filters of one size are joined by ``merged``."""
    id_ = F.col(column)
    words = ids.select(block(id_, blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(masks(id_))))
    return words.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS))).select("block", F.array(*(f"w{k}" for k in range(WORDS))).alias("words"))


def merged(filters: DataFrame, more: DataFrame) -> DataFrame:
    """The filter of the ids of both: new ids need no second pass over the old."""
    each = filters.unionByName(more).select("block", *(F.get("words", F.lit(k)).alias(f"w{k}") for k in range(WORDS)))
    return each.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS))).select("block", F.array(*(f"w{k}" for k in range(WORDS))).alias("words"))


def maybe(probes: DataFrame, column: str, filters: DataFrame, blocks: int) -> DataFrame:
    """Probes that the filter may know, and ``_may`` for the others false."""
    id_ = F.col(column)
    rows = F.broadcast(filters) if blocks <= BROADCAST_ROWS else filters
    hit = F.lit(True)
    for k, m in enumerate(masks(id_)):
        hit = hit & (F.get("words", F.lit(k)).bitwiseAND(m) != 0)
    return probes.withColumn("block", block(id_, blocks)).join(rows, "block", "left").withColumn("_may", F.coalesce(hit, F.lit(False))).drop("block", "words")


def missing(wanted: DataFrame, ids: DataFrame, column: str, filters: DataFrame, blocks: int) -> DataFrame:
    """Distinct wanted ids that are not among ``ids``, exactly; ``filters`` is that of ``ids``."""
    from foldlake.session import settled

    asked = settled(maybe(wanted.select(column).distinct(), column, filters, blocks))
    likely = asked.where("_may").select(column)
    # the ids are read past the few probes and are not dealt by key unless these are many
    there = ids.select(column).join(F.broadcast(likely) if likely.count() <= BROADCAST_ROWS else likely, column, "left_semi").distinct()
    return asked.where("NOT _may").select(column).unionByName(likely.join(there, column, "left_anti"))
