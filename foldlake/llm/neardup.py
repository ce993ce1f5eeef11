"""MinHash near-dedup with odd sketches.

A document's set holds the hashes of its distinct word shingles.  ``bands x rows`` MinHash samples of the set give
band keys (documents that agree on a whole band are candidates) and are folded into a parity bitmap, the odd
sketch: every sample flips one bit, so the samples that two documents share cancel in the XOR of their bitmaps and
its population count estimates a high similarity precisely.  A candidate pair whose bitmaps differ in more than ``max_odd``
bits is dropped before its sets are read; what remains is confirmed on the full sets.

Documents with equal sets are one node from the start.  Candidates never form all pairs of a band's bucket:

* each bucket links its nodes to its centre, the member that shares most buckets with others; the links found are
  contracted to components, and buckets of one component are done;
* in what is left open, shingles that few of the open sets hold bound what two sets can share (all but the rare shingles
  of either, plus the rare ones they do share).  A node with too many shingles of its own drops out of the bucket, and
  only pairs of different components whose bound allows the similarity are confirmed on their full sets.

Both bounds are exact, so no link between different texts is lost, while a large group of edited copies costs one pair a
member and the few that its centre leaves open.

With the default 32 bands of 4 rows a pair of similarity 0.8 shares no bucket with probability 5e-8, and the
bitmap drops it with a probability below 1e-9.

Defined cases: null and empty texts have an empty set and are linked with nothing; fewer words than a shingle give
the whole sequence as one shingle; rows with a null id are linked like others, and their component is the smallest
non-null id reachable (null if there is none); repeated rows are equal sets; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import components, flat, map_arrow, mix, powers, runs_hash, scratch, shared_table, slices, small, word_runs

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: 64-bit words of an odd sketch.
SKETCH = 8
#: Open sets that may hold a shingle for it to count as rare.
RARE = 32


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, ascending, and their n+1 offsets."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    starts, ends = word_runs(data, offsets)
    hashed = runs_hash(LOWER[data], starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), made)
    at = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + first[owner]
    power = powers(words + 1)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        short = count[owner] <= k
        value = value + np.where(short, np.uint64(0), mix(hashed[np.minimum(at + k, max(len(hashed) - 1, 0))] + power[k]) * power[k + 1]) if len(at) else value
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


def signatures(value: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x SKETCH) of the nonempty sets; zeros for empty ones."""
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    rng = np.random.default_rng(seed)
    flip, times = rng.integers(0, 2**64, bands * rows, np.uint64), rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    place = np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    keys, odd = np.zeros((n, bands), np.uint64), np.zeros((n, SKETCH), np.uint64)
    if not len(full):
        return keys, odd
    at = offsets[:-1][full]
    for b in range(bands):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            i = b * rows + r
            # the high half decides: multiply, fold, then take the least of each text
            x = (value ^ flip[i]) * times[i]
            least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            bit = mix(least + place[i]) % np.uint64(64 * SKETCH)
            odd[full, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
        keys[full, b] = key
    return keys, odd


def sketch(docs: DataFrame, words: int, bands: int, rows: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: row key, id, set size, 128-bit set fingerprint, band keys and odd sketch."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    schema = f"row long, doc_id {source.schema[0].dataType.simpleString()}, t long, n_shingles long, f1 long, f2 long, keys array<long>, odd array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                value, offsets = shingle_sets(part.column("text"), words)
                keys, odd = signatures(value, offsets, bands, rows, seed)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (keys, odd)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("t"), pa.array(np.diff(offsets)), *(pa.array(p) for p in fingerprint(value, offsets)), *lists], names=[x.split(" ")[0] for x in schema.split(", ")])
                row += n

    return map_arrow(source, run, schema)


def fingerprint(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set; zeros for empty ones."""
    full = np.diff(offsets) > 0
    prints = np.zeros((2, len(full)), np.uint64)
    if full.any():
        prints[0, full] = np.add.reduceat(mix(value + np.uint64(1)), offsets[:-1][full])
        prints[1, full] = np.bitwise_xor.reduceat(mix(value + np.uint64(2)), offsets[:-1][full])
    return prints.view(np.int64)


def sets_of(found: DataFrame, words: int) -> DataFrame:
    """``node`` and full set; a row whose set is not the node's (a repeated id with another text) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, offsets = shingle_sets(part.column("text"), words)
                made = pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.view(np.int64)))], names=["node", "set"])
                yield made.filter(pa.array(fingerprint(value, offsets)[0] == part.column("f1").to_numpy()))

    return map_arrow(found, run, "node long, set array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def link(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, max_odd: int = 115, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    with scratch() as keep:
        made, table = classes(docs, words, percent, bands, rows, max_odd, seed, id_col, text_col)
        keep(made), keep(table)
    out = made.select("doc_id", "n_shingles", "f1", "f2").join(table, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("gn")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def classes(docs: DataFrame, words: int, percent: int, bands: int, rows: int, max_odd: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Tables of every document's set (``doc_id, n_shingles``, fingerprint) and of every set's ``component_id``."""
    made = shared_table(sketch(docs, words, bands, rows, seed, id_col, text_col))
    # equal sets: one node, named by a row key
    nodes = shared_table(made.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    own = made.join(if_small(nodes.select(F.col("node").alias("row"))), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "t", "f1", F.col("n_shingles").alias("n"), "keys", "odd")
    buckets = own.select("node", F.explode("keys").alias("key"))
    shared = shared_table(buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    members = shared_table(buckets.join(if_small(shared), "key"))
    info = shared_table(own.join(if_small(members.select("node").distinct()), "node", "left_semi").drop("keys"))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and odd sketches allow the similarity."""
        left, right = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
        p = pairs.join(left, "a").join(right, "b")
        return p.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(odd_distance("oa", "ob") <= max_odd).select("a", "b")

    def full_sets(of: DataFrame) -> DataFrame:
        wanted = if_small(info.join(of, "node", "left_semi").select("node", "f1", F.col("doc_id").alias("_id"), F.col("t").alias("_t")))
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
        # by text and id: rows without an id, or with one id, are told apart by what they hold
        return shared_table(sets_of(texts.join(wanted, (texts["t"] == wanted["_t"]) & texts["doc_id"].eqNullSafe(wanted["_id"])).select("node", "f1", "text"), words).dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        if sets is None:
            pairs = shared_table(pairs)
            sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return shared_table(confirm(pairs, sets, percent))

    # each bucket around its most connected node: for edited copies of a text that is the one nearest to the text
    score = members.groupBy("node").agg(F.sum("members").alias("score"))
    scored = members.join(score, "node")
    centre = scored.groupBy("key").agg(F.max(F.struct("score", "node")).getField("node").alias("a"))
    star = members.join(centre, "key").where("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links = confirmed(near(star))
    groups = shared_table(components(links))

    # nodes of different components that still share a bucket
    placed = shared_table(members.join(groups.select(F.col("id").alias("node"), "component"), "node", "left").join(info.select("node", "n"), "node").select("key", "node", "n", F.coalesce("component", "node").alias("component")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("n").alias("low")).where("c1 <> c2").select("key", "low")
    open_ = shared_table(placed.join(mixed, "key"))
    sets = full_sets(open_.select("node").distinct())
    open_ = shared_table(open_.join(rare_shingles(sets), "node", "left").select("key", "node", "n", "component", "low", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("rare", F.lit(0)).alias("rare"), F.coalesce("few", F.array().cast("array<long>")).alias("few")))
    # a node with too many shingles of its own is linked with nobody in the bucket, whose sets have ``low`` at least
    open_ = open_.where(100 * (F.col("n") - F.col("alone")) >= percent * (F.col("low") + F.col("alone")))
    open_ = shared_table(open_.join(info.select("node", "odd"), "node"))
    places = open_.groupBy("node").agg(F.collect_set("key").alias("keys"))
    open_ = open_.join(places, "node")
    side = lambda x: open_.select("key", F.col("node").alias(x), *[F.col(c).alias(f"{c[0]}_{x}") for c in ("n", "component", "rare", "few", "odd", "keys")])
    left, right = side("a").withColumnRenamed("key", "_key"), side("b")
    # the most that two sets can share: all but the rare shingles of either, and the rare ones they do share
    most = F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b"))
    able = 100 * (most + F.least("r_a", "r_b")) >= percent * (F.col("n_a") + F.col("n_b") - most - F.least("r_a", "r_b"))
    common = most + F.size(F.array_intersect("f_a", "f_b"))
    bound = 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)
    # of all buckets that two nodes share, the least proposes the pair: no pair is made twice
    once = F.col("key") == F.array_min(F.array_intersect("k_a", "k_b"))
    same = (F.col("_key") == F.col("key")) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & able & (odd_distance("o_a", "o_b") <= max_odd) & once & bound
    more = confirmed(left.join(right, same).select("a", "b"), sets)
    groups = components(links.union(more))

    table = shared_table(nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = table.groupBy("component").agg(F.min("least").alias("component_id"))
    return made, shared_table(table.join(least, "component").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_shingles").alias("gn"), "component_id"))


def odd_distance(a: str, b: str) -> Column:
    """Population count of the XOR of two odd sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def rare_shingles(sets: DataFrame) -> DataFrame:
    """Per node: shingles that no other of ``sets`` holds (``alone``), that at most RARE hold (``rare``), and the shared ones of those (``few``)."""
    each = sets.select("node", F.explode("set").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("times")).where(F.col("times") <= RARE)
    return each.join(held, "shingle").groupBy("node").agg(F.count(F.when(F.col("times") == 1, 1)).alias("alone"), F.count("*").alias("rare"), F.collect_list(F.when(F.col("times") > 1, F.col("shingle"))).alias("few"))


def if_small(df: DataFrame) -> DataFrame:
    """``df`` as a table, to be broadcast if it is small."""
    return small(shared_table(df))
