"""Quality rules with cross-document line frequency.

One pass over the texts takes the per-document counts and the hashes of the document's normalised lines (case
and white space folded, digits to 0).  The documents of a host (``source``) that hold a line are counted, equal texts once; a
line found in more than ``max_share`` of a host's documents (and in more than ``min_docs``, for small hosts) is boilerplate.
A document whose words outside boilerplate fall under ``min_rest`` of its words is depleted and rejected, as is
one that fails the base rules (fewer than ``min_words`` words, or too many words in repeated 3-word windows).

Lines are counted with map-side partial sums, so a line that a third of all documents hold is no hot key.
The lines above ``min_docs`` are joined back by broadcast if they are at most ``BROADCAST_ROWS``, else by a shuffle.

``clean`` needs the columns ``text`` and ``source``, keeps all others, and counts ``n_chars`` again where it cuts.

Defined cases: null and empty texts have all counts 0 and fail the base rules; a null host is a host of its own; null
ids and repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import ROW, flat, map_arrow, mix, powers, row_key, runs_hash, shared_table, slices, word_runs

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
#: Bytes as the line hash sees them: lower case, digits alike.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 32
FOLDED[0x30:0x3A] = 0x30
#: Rows (16 bytes each) up to which frequent lines are broadcast.
BROADCAST_ROWS = 500_000
#: On ``sf0.1`` the header line of every host is in 43 to 65 of its 493 to 499 texts, every other line in at most 23.
MIN_DOCS, MAX_SHARE = 5, 0.05

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def host_seed(host: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"\0" if host is None else b"h" + host.encode())


def measure(texts: pa.Array, hosts: list[str | None] | None = None) -> dict:
    """The five counts of each text and, with ``hosts``, its distinct normalised lines with their words and a text hash."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    starts, ends = word_runs(data, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64)}

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)

    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    out["word_chars"] = per_doc((np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per_doc(IS_SYMBOL[data])

    # lines: cut at \n and at the ends of texts; only those with a word count
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(data)], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    of_word = np.searchsorted(line_start, starts, "right") - 1
    lines, first_word, n_line_words = np.unique(of_word, return_index=True, return_counts=True)
    l_start = line_start[lines]
    l_doc = doc[first_word] if len(lines) else np.zeros(0, np.int64)
    l_break = np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, l_start)] if len(lines) else l_start
    l_end = np.minimum(l_break, offsets[1:][l_doc]) if len(lines) else l_start
    exact = mix(runs_hash(data, l_start, l_end) + l_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    once = np.unique(exact, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(l_doc, minlength=n).astype(np.int64) - np.bincount(l_doc[once], minlength=n)

    # 3-word windows that occur twice or more in their text
    hashed = runs_hash(data, starts, ends)
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        p = powers(4)
        window = mix(hashed[:-2] * p[1] + mix(hashed[1:-1]) * p[2] + mix(hashed[2:] * p[3] + doc[2:].astype(np.uint64)))
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        _, back, times = np.unique(window[whole], return_inverse=True, return_counts=True)
        again = whole[times[back] > 1]
        for k in range(3):
            repeated[again + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=n).astype(np.int64)

    if hosts is not None:
        seeds = np.array([host_seed(h) for h in hosts], np.uint64)
        folded = runs_hash(FOLDED[data], starts, ends)
        place = np.arange(len(starts)) - np.repeat(first_word, n_line_words)
        total = np.add.reduceat(folded * powers(int(n_line_words.max()))[place], first_word) if len(lines) else np.zeros(0, np.uint64)
        key = mix(mix(total) + seeds[l_doc]) if len(lines) else total
        whole, back = np.unique(np.stack([l_doc.astype(np.uint64), key]), axis=1, return_inverse=True) if len(lines) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
        out["line_doc"], out["line_key"] = whole[0].astype(np.int64), whole[1].view(np.int64)
        out["line_words"] = np.bincount(back.ravel(), weights=n_line_words, minlength=whole.shape[1]).astype(np.int64)
        out["text_hash"] = mix(runs_hash(data, offsets[:-1], offsets[1:]) + seeds).view(np.int64)
        out["word_line_key"] = key.view(np.int64)
        out["line_span"] = (l_doc, l_start - offsets[:-1][l_doc], l_end - offsets[:-1][l_doc]) if len(lines) else (l_doc, l_start, l_end)
    return out


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: a row key, the id, host, counts, text hash and its distinct lines (key, words)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    schema = f"row long, doc_id {source.schema[0].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", text_hash long, line_keys array<long>, line_words array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"), part.column("host").to_pylist())
                at = np.searchsorted(m["line_doc"], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(m[k])) for k in ("line_key", "line_words")]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), part.column("host"), *(pa.array(m[c]) for c in COUNTS), pa.array(m["text_hash"]), *lists], names=[x.split(" ")[0] for x in schema.split(", ")])
                row += part.num_rows

    return map_arrow(source, run, schema)


def frequent_lines(rows: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """``row, line_key, words`` of every boilerplate line in a document; ``rows`` is a table of ``profile``."""
    first = rows.groupBy("host", "text_hash").agg(F.min("row").alias("row"))
    sizes = first.groupBy("host").agg(F.count("*").alias("docs"))
    counted = rows.select("row", F.explode("line_keys").alias("line_key")).join(first.select("row"), "row", "left_semi")
    often = shared_table(counted.groupBy("line_key").agg(F.count("*").alias("n")).where(F.col("n") > min_docs))
    often_ = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    lines = rows.select("row", "host", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("row", "host", F.col("l.line_keys").alias("line_key"), F.col("l.line_words").alias("words"))
    held = lines.join(often_, "line_key")
    sizes = sizes.withColumnRenamed("host", "_host")
    held = held.join(sizes, held["host"].eqNullSafe(sizes["_host"]))
    return held.where(F.col("n") > F.col("docs") * max_share).select("row", "line_key", "words")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_rest: float = 0.2, min_words: int = 50, max_repeat: float = 0.5, host_col: str = "source") -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``n_boilerplate_words`` and ``kept``."""
    rows = shared_table(profile(docs, host_col=host_col))
    lost = frequent_lines(rows, min_docs, max_share).groupBy("row").agg(F.sum("words").alias("lost"))
    out = rows.select("row", "doc_id", *COUNTS).join(lost, "row", "left").withColumn("n_boilerplate_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeat) * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_boilerplate_words")) < min_rest * F.col("n_words")
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_boilerplate_words")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_rest: float = 0.2, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns; boilerplate lines are taken out of the texts that hold any."""
    keyed = docs.withColumn(ROW, row_key(docs))  # ids may be null or repeated; equal rows have one verdict
    rows = shared_table(profile(keyed, id_col=ROW))
    held = frequent_lines(rows, min_docs, max_share).groupBy("row").agg(F.sum("words").alias("lost"), F.collect_set("line_key").alias("keys"))
    passed = rows.select("row", "doc_id", "text_hash", "n_words", "n_repeat_words").join(held, "row", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeat) * F.col("n_words"))
    depleted = (F.col("n_words") - F.coalesce("lost", F.lit(0))) < min_rest * F.col("n_words")
    passed = passed.where(~failed & ~depleted).groupBy(F.col("doc_id").alias(ROW)).agg(F.first(F.coalesce("keys", F.array().cast("array<long>"))).alias("_foldlake_keys"))
    out = keyed.join(passed, ROW).drop(ROW)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_foldlake_keys").to_pylist()
            texts = batch.column("text").to_pylist()
            chars = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, k in enumerate(keys):
                if k:
                    m = measure(pa.array([texts[i]]), [batch.column("source")[i].as_py()])
                    body, at, kept = texts[i].encode(), 0, []
                    for key, a, b in zip(m["word_line_key"], m["line_span"][1], m["line_span"][2]):
                        if key in k:
                            kept.append(body[at:a])
                            at = min(b + 1, len(body))
                    texts[i] = (b"".join(kept) + body[at:]).decode()
                    if chars is not None:
                        chars[i] = len(texts[i])
            columns = [pa.array(texts, pa.string()) if c == "text" else pa.array(chars, pa.int64()) if c == "n_chars" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(out, run, schema)
