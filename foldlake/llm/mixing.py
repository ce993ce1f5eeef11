"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a pseudo-random order; a document's virtual finish time is the source's
cumulative tokens up to it divided by the source's target.  All documents are ordered by finish time and the
order is truncated at the total budget, so every source is served in proportion to its target.  A source whose
target exceeds its size is passed again (in another order) up to ``epochs`` times.

The order by finish time is a global range sort of which only one range is sorted: the histogram of even ranges (steps)
says in which the budget ends, those before it are taken whole and those after it not, with the result of sorting all.
Both running sums are taken without a source or the whole order in one task: documents fall into even
cells of their order's hash, cells get the sum of those before, and finish times fall into even steps
(each step holds about the same number of tokens), of which only the one in which the budget ends is summed row by row.

Defined cases: a null or empty text has size 0, finishes with the document before it and takes nothing; null is a
source of its own, last in order; repeated rows are documents of their own, each with its own place; sources without a
word have target 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import drop_table, flat, map_arrow, shared_table, slices, word_runs

#: Rows to a cell of the shuffled order within a source, and to a step of virtual time; both numbers follow the table.
ROWS, FEWEST, MOST = 20_000, 256, 200_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, key: list[str]) -> DataFrame:
    """``doc_id, source, size`` (words of the whole text), ``_crc`` and the columns ``key`` of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), *key)
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                starts, _ = word_runs(data, offsets)
                size = np.diff(np.searchsorted(starts, offsets))
                crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(size), pa.array(crc, pa.int64()), *map(part.column, key)], names=["doc_id", "source", "size", "_crc", *key])

    return map_arrow(source, run, ", ".join([f"doc_id {kind}, source string, size long, _crc long", *(f"{k} {source.schema[k].dataType.simpleString()}" for k in key)]))


def fair_targets(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Share ``budget`` by weight; a target stops at ``cap`` times its size and the excess is reshared until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    rest = float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def mix(docs: DataFrame, weights: list[float], budget_ratio: float = 1.5, epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """One row per document and pass: ``doc_id, source, size, source_size, target, epoch, finish, chosen``, and ``key_col`` if given.

    ``weights`` repeat over the sources in code point order, null last.  The list of sources and their sizes is what a
    mix is configured by and goes to the driver; nothing else does.
    """
    spark = docs.sparkSession
    own = [key_col] if key_col else []
    base = sized(docs, id_col, text_col, source_col, own)
    base = shared_table(base)  # a few numbers a row: the texts are read once
    found = [(s, int(n), k) for s, n, k in base.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    totals, counts = [(s, n) for s, n, _ in found], [k for *_, k in found]
    n_cells = min(max(FEWEST, -(-max(counts, default=0) // ROWS)), MOST)
    n_steps = min(max(FEWEST, -(-sum(counts) // ROWS)), MOST)
    totals.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    sizes = [n for _, n in totals]
    targets = fair_targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], budget_ratio * sum(sizes), float(epochs))
    budget = int(budget_ratio * sum(sizes))
    known = spark.createDataFrame([(s, n, t) for (s, n), t in zip(totals, targets)], "_source string, source_size long, target double")
    known = F.broadcast(known) if len(totals) <= 100_000 else known
    rows = base.join(known, base["source"].eqNullSafe(known["_source"])).drop("_source")
    passes = F.least(F.lit(epochs), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")).cast("int")))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    # rows without an id are told apart by their text
    rows = rows.withColumn("_mix", F.xxhash64(F.lit(seed), "epoch", "doc_id", F.when(F.isnull("doc_id"), F.col("_crc"))))
    rows = rows.withColumn("_cell", F.pmod("_mix", F.lit(n_cells)).cast("int"))
    key = ["source", "epoch", "_cell"]
    cells = rows.groupBy(key).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("epoch", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key).orderBy("_mix", "doc_id", "size", "_crc", *own).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(inside))
    right = cells.toDF("_s", "_e", "_c", "_before")
    rows = rows.join(right, rows["source"].eqNullSafe(right["_s"]) & (rows["epoch"] == right["_e"]) & (rows["_cell"] == right["_c"])).drop("_s", "_e", "_c")
    finish = F.when(F.col("target") > 0, (F.col("_before") + F.col("_in")) / F.col("target")).otherwise(F.lit(0.0))
    rows = rows.withColumn("finish", finish).withColumn("_step", F.least(F.floor(F.col("finish") * n_steps), F.lit(4 * n_steps)).cast("int"))
    rows = shared_table(rows.select("doc_id", "source", "size", "source_size", "target", "epoch", "finish", "_crc", "_mix", "_step", *own))
    drop_table(base)
    # where does the budget end?  at most 4 x n_steps + 1 numbers
    steps, taken, cut = sorted((k, int(n)) for k, n in rows.groupBy("_step").agg(F.sum("size")).collect()), 0, None
    for k, n in steps:
        if taken + n > budget:
            cut = k
            break
        taken += n
    if cut is None:
        return rows.withColumn("chosen", F.lit(True)).select(*RESULT, *own)
    last = rows.where(F.col("_step") == cut)
    running = Window.partitionBy("_step").orderBy("finish", "source", "epoch", "_mix", "doc_id", "size", "_crc", *own).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("chosen", F.sum("size").over(running) <= budget - taken)
    rest = rows.where(F.col("_step") != cut).withColumn("chosen", F.col("_step") < cut)
    return rest.select(*RESULT, *own).unionByName(last.select(*RESULT, *own))


RESULT = ("doc_id", "source", "size", "source_size", "target", "epoch", "finish", "_crc", "_mix", "chosen")


def taken(mixed: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``; what is taken is whole copies of the document."""
    out = mixed.groupBy("doc_id", "source", "size", "source_size", "target", "_crc").agg(F.sum(F.col("chosen").cast("long")).alias("_copies"), F.sum(F.when(F.col("epoch") == 0, 1).otherwise(0)).alias("_rows"))
    # rows that repeat id and text are told apart again: each has its share of the copies, the first ones what is left over
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    own = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_k") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (own * F.col("size")).cast("long").alias("taken"))
