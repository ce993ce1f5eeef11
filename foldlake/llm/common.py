"""Helpers shared by the training-data operators: shared-folder tables, Arrow text access, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.session import shared_dir

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: The same set as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldlake-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._foldlake_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(back)
    return back


_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables of ``shared_table`` made inside are deleted at the end, but for those passed through what this yields."""
    made, kept = [], []
    _SCRATCH.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._foldlake_path)
        return table

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for table in made:
            if table._foldlake_path not in kept:
                drop_table(table)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``shared_table`` that no later plan reads."""
    spark, path = df.sparkSession, df._foldlake_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows up to which a table of numbers is broadcast.
BROADCAST_ROWS = 400_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of ``shared_table``, to be broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def row_key(docs: DataFrame) -> Column:
    """128-bit hash of a whole row; only equal rows share it.  Nulls are marked, as ``xxhash64`` passes over them."""
    # maps and what holds them have no hash of their own
    unhashed = ("map<", "variant")
    cell = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(x in f.dataType.simpleString() for x in unhashed) else F.col(f"`{f.name}`")
    cells = [x for f in docs.schema for x in (cell(f), F.isnull(F.col(f"`{f.name}`")))]
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *cells)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


#: The column that a row's key goes by beside the columns of a table; the one name a table of documents must not have.
ROW = "_foldlake_row"


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``chosen`` (``ROW``, once each, and columns to add); of equal rows one."""
    return docs.withColumn(ROW, row_key(docs)).join(chosen, ROW).dropDuplicates([ROW]).drop(ROW)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a reused Python worker: memory that it freed goes back to the system when its task ends, instead of adding up over the stages."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return held


#: Bytes of an Arrow batch on its way to Python and back; the JVM holds a batch outside of its heap, the worker too.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes and not by rows only; the bound is set in the session, which has it when the plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)


#: Bytes of text that the array operations take at a time; they hold some ten numbers of 8 bytes for each.
PART = 1 << 19


def slices(batch: pa.RecordBatch, column: str, limit: int = PART) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (a longer single text is a part of its own)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and their n+1 offsets; null counts as empty."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def runs_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run ``data[starts[i]:ends[i]]``; the runs ascend and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = _BYTE[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()) if len(lengths) else 1)[place]
    full = lengths > 0
    out = np.zeros(len(starts), np.uint64)
    if full.any():
        first = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(terms, first)
    return mix(out + lengths.astype(np.uint64) * _MIX_B)


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words never cross texts."""
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``; the result has ``id`` and ``component`` (the smallest id reachable)
    for every id in an edge.  Each step is one grouping without any group held in a task: minima are
    pre-aggregated and the star is a join.  Every step is cut with a table in the shared folder.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        kept = joined.where("v <= u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
        return kept.union(own).where("a <> b").distinct()

    def total(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())

    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b"))).distinct()
    now = shared_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = total(now)
    for _ in range(rounds):
        after = shared_table(star(star(now, True), False))
        sign = total(after)
        drop_table(now)
        now = after
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
