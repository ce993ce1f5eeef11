"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring.  A key goes to the shard of the first point clockwise from its
hash; a shard takes rows up to its bound, and keys that overflow a full shard continue clockwise to the next
point of a shard with room.  With ``slack=0`` the bounds are the floor and ceiling of rows / shards, so counts
differ by one at most; with more slack less keys move when a shard is added.

The flow needs only the number of keys on each arc (shards x vnodes numbers, whatever the input), so it is
settled once on those on the driver (a million numbers at most): arcs are served in ring order, and the keys of one arc that a shard takes are a run of the
arc's keys in hash order.  The result is a small table of runs; every row finds its run by its rank within
its arc, which is the only shuffle (thousands of even groups, no group of a shard's size in a task).

Defined cases: a null text has size 1 (0 bytes plus 1) and the crc32 of no bytes; a row with a null id is a key of its
own; rows that repeat an id lie on the same arc next to each other and each get a slot; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import shared_table

#: Rows to an arc, of which a window holds one: the number of virtual nodes follows the table unless it is given.
ARC_ROWS = 100_000


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending signed 64-bit points and the shard that owns each."""
    at = [(int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int32)


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(owner: np.ndarray, counts: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, slot of the first rank).

    Every arc first offers all keys to its own shard, in ring order; what does not fit moves on to the next
    clockwise point whose shard has room.
    """
    n, left, used, done, runs = len(owner), list(room), [0] * len(room), [0] * len(counts), []

    def give(arc: int, shard: int) -> None:
        if (k := min(int(counts[arc]) - done[arc], left[shard])) > 0:
            runs.append((arc, done[arc], done[arc] + k, shard, used[shard]))
            done[arc] += k
            left[shard] -= k
            used[shard] += k

    for arc in np.flatnonzero(counts):
        give(int(arc), int(owner[arc]))
    for arc in np.flatnonzero(counts):
        at = int(arc)
        while done[arc] < counts[arc]:
            at = (at + 1) % n
            give(int(arc), int(owner[at]))
    return runs


def assign(docs: DataFrame, shards: int = 16, vnodes: int | None = None, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_no"))
    # rows without an id have no place of their own: their number spreads them
    rows = shared_table(rows.withColumn("_at", F.xxhash64(F.lit("key"), "doc_id", F.when(F.isnull("doc_id"), F.col("_no")))).drop("_no"))  # five numbers a row: the texts are read once
    if vnodes is None:
        vnodes = min(max(256, -(-rows.count() // (shards * ARC_ROWS))), 1 << 16)
    points, owner = ring(shards, vnodes)
    # the arc of a hash by a guess over even cells and a search among the points of the cell
    cells = 1 << int(np.ceil(np.log2(len(points))))
    shift = 64 - int(np.log2(cells))
    low = np.searchsorted(points, (np.arange(cells, dtype=np.int64) << shift) + np.int64(-(2**63)), "left")
    # per cell: index of its first point, and the points in it; both literal arrays are as long as the ring
    inside = [[int(p) for p in points[a:b]] for a, b in zip(low, [*low[1:], len(points)])]
    cell = (F.shiftrightunsigned(F.col("_at").bitwiseXOR(F.lit(-(2**63))), shift)).cast("int")
    table = spark.createDataFrame([(k, int(low[k]), inside[k]) for k in range(cells)], "_cell int, _low int, _points array<long>")
    rows = rows.withColumn("_cell", cell).join(F.broadcast(table), "_cell")
    first = F.col("_low") + F.size(F.filter("_points", lambda p: p < F.col("_at")))
    rows = rows.withColumn("_arc", F.when(first == len(points), 0).otherwise(first)).drop("_cell", "_low", "_points")
    counts = np.zeros(len(points), np.int64)
    for arc, n in rows.groupBy("_arc").count().collect():  # shards x vnodes rows at most
        counts[arc] = n
    runs = settle(owner, counts, bounds(int(counts.sum()), shards, slack))
    plan = spark.createDataFrame(runs, "_arc int, _from long, _to long, shard int, _slot long")
    plan = plan.groupBy("_arc").agg(F.collect_list(F.struct("_from", "_to", "shard", "_slot")).alias("_runs"))
    order = Window.partitionBy("_arc").orderBy("_at", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order).cast("long") - 1).join(F.broadcast(plan), "_arc")
    run = F.element_at(F.filter("_runs", lambda x: (x["_from"] <= F.col("_rank")) & (F.col("_rank") < x["_to"])), 1)
    return ranked.withColumn("_run", run).select("doc_id", "size", "text_crc32", F.col("_run.shard").alias("shard"), (F.col("_run._slot") + F.col("_rank") - F.col("_run._from")).alias("slot"))
