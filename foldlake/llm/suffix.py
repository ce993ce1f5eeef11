"""Suffix-array dedup with the difference-cover algorithm.

Every byte covered by a string of ``length`` bytes that also starts anywhere else in the corpus is found with suffix
arrays.  A suffix array of the whole corpus in one place does not scale, and is not needed: two equal strings choose
the same anchor, the window's least hashed k-gram (winnowing), so strings dealt by their anchor meet.

1. Equal texts become one text with a count (a text of two rows repeats as a whole).
2. Every text gives its anchors, each with the run of string starts that chose it.  Anchors that occur once in the
   corpus cannot hold a repeat; they go, without loss.
3. The stretch of text around every other anchor (its starts plus ``length`` bytes) is dealt by the anchor's hash.
   Anchors of more than ``HOT`` stretches are dealt by short bands of starts and the bytes all strings of the band share,
   so a passage that a third of all documents hold spreads over the tasks.
4. Each task sorts the suffixes of its stretches, some whole anchors at a time, with the difference-cover algorithm:
   the triples at positions 1 and 2 modulo 3 are sorted and named, the string of names is sorted by
   recursion (until names cover ``length`` bytes), the remaining suffixes are sorted by their first byte and the
   next one's rank and merged, and adjacent prefixes are compared.
5. The starts found come back to their text, overlaps are united, and the bytes are cut.

Defined cases: null counts as the empty text; texts under ``length`` bytes lose nothing unless ``length`` fits; null
ids and repeated rows are texts like others and get a row each; an empty table gives no rows; other columns
are not read.  Matches never cross texts, and are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import flat, map_arrow, mix, powers, scratch, shared_table, slices, small

#: Bytes of the k-gram that anchors a string.
GRAM = 48
#: Stretches of one anchor beyond which it is dealt in bands, and starts to a band.
HOT, BAND = 2000, 8
#: Bytes of distinct stretches sorted at a time, and of those that a task deals at a time.
BLOCK, SHARE = 1 << 18, 2 << 20
#: Repeated anchors (16 bytes each), and texts with spans, up to which these are broadcast.
ANCHOR_ROWS, SPANS_ROWS = 1_000_000, 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- the suffix array
def ordered_names(key: np.ndarray) -> np.ndarray:
    """1-based rank of each key; equal keys share one."""
    order = np.argsort(key)
    step = np.ones(len(key), np.int64)
    ranked = key[order]
    step[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_ranks(symbols: np.ndarray, key: np.ndarray | None, covered: int, stride: int, need: int) -> np.ndarray:
    """1-based place of every suffix in an order by (at least) the first ``need`` bytes.

    A symbol names ``covered`` bytes, neighbours in ``symbols`` are ``stride`` bytes apart; ``key`` may give a prefix
    of 3 symbols or more of each position as one number.
    """
    n = len(symbols)
    x = np.concatenate([symbols, np.zeros(3, np.int64)])
    at1, at2 = np.arange(1, n, 3), np.arange(2, n, 3)
    at = np.concatenate([at1, at2])
    reach = covered + 2 * stride
    if key is None:
        base = int(x.max()) + 1
        if base < 1 << 21:
            key = (x[at] * base + x[at + 1]) * base + x[at + 2]
        else:
            pair = ordered_names(x[at] * base + x[at + 1])
            key = pair * base + x[at + 2]
    else:
        key = key[at]
        reach = max(reach, 8)
    names = ordered_names(key)
    if len(names) and int(names.max()) < len(names) and reach < need:
        # a 0 between the residues ends the suffixes of the first
        deeper = suffix_ranks(np.concatenate([names[: len(at1)], [0], names[len(at1) :]]), None, reach, 3 * stride, need)
        names = np.delete(deeper, len(at1))
    rank = np.zeros(n + 3, np.int64)
    rank[at] = names
    at0 = np.arange(0, n, 3)
    size = int(names.max()) + 1 if len(names) else 1
    key0 = x[at0] * size + rank[at0 + 1]
    order0 = at0[np.argsort(key0, kind="stable")]
    order12 = at[np.argsort(names, kind="stable")]
    # where the remaining suffixes go among the sampled ones, for either residue by its own comparison
    one, two = order12[order12 % 3 == 1], order12[order12 % 3 == 2]
    before1 = np.searchsorted(x[one] * size + rank[one + 1], x[order0] * size + rank[order0 + 1])
    base = int(x.max()) + 1
    if base * base * size < 1 << 62:
        k2 = (x[two] * base + x[two + 1]) * size + rank[two + 2]
        k0 = (x[order0] * base + x[order0 + 1]) * size + rank[order0 + 2]
    else:
        both = ordered_names(np.concatenate([x[two] * base + x[two + 1], x[order0] * base + x[order0 + 1]]))
        k2 = both[: len(two)] * size + rank[two + 2]
        k0 = both[len(two) :] * size + rank[order0 + 2]
    place0 = np.arange(len(order0)) + before1 + np.searchsorted(k2, k0)
    place0 = np.maximum.accumulate(place0 - np.arange(len(order0))) + np.arange(len(order0))
    out = np.zeros(n, np.int64)
    out[order0] = place0 + 1
    free = np.ones(n, bool)
    free[place0] = False
    out[order12] = np.flatnonzero(free) + 1
    return out


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; ``data`` ends with 8 spare bytes."""
    n = len(data) - 8
    view = np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts``: does its string of ``length`` bytes begin at another of ``starts`` too?"""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    padded = np.concatenate([data, np.zeros(3 * length + 16, np.uint8)])
    words = words8(padded)
    n = len(data) + 2 * length
    rank = suffix_ranks(padded[:n].astype(np.int64) + 1, words[:n], 1, 1, length)
    order = starts[np.argsort(rank[starts], kind="stable")]
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        alive = alive[words[left[alive] + k] == words[right[alive] + k]]
    if length < 8:
        shift = np.uint64(64 - 8 * length)
        alive = alive[words[left] >> shift == words[right] >> shift]
    same = np.zeros(len(data) + 1, bool)
    same[left[alive]] = True
    same[right[alive]] = True
    return same[starts]


# ---- anchors
def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the k-gram at each position (of those that fit)."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    power = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    inverse = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    return mix((total[gram:] - total[:-gram]) * inverse[: n + 1 - gram])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(key)
    if n < width:
        return key[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1), np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, first start, last start, anchor (all relative to the text) and its hash."""
    hashed = gram_hashes(data, gram)
    key = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    least = (sliding_least(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fit = np.maximum(np.diff(offsets) - length + 1, 0)  # starts of each text
    owner = np.repeat(np.arange(len(fit)), fit)
    begin = np.repeat(offsets[:-1] - (np.cumsum(fit) - fit), fit) + np.arange(len(owner))
    chosen = least[begin] if len(begin) else begin
    new = np.ones(len(begin), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(begin)) - 1 if len(at) else at
    text = owner[at]
    return text, begin[at] - offsets[text], begin[last] - offsets[text], chosen[at] - offsets[text], hashed[chosen[at]].view(np.int64)


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Per text: row key, digest and its anchors (hash, first start, last start, place)."""
    names = ("hashes", "firsts", "lasts", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                data, offsets = flat(part.column("text"))
                text, first, last, place, hashed = anchors(data, offsets, length, gram)
                at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (hashed, *(y.astype(np.int32) for y in (first, last, place)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + part.num_rows)), part.column("sha"), *lists], names=["row", "sha", *names])
                row += part.num_rows

    return map_arrow(texts, run, "row long, sha string, hashes array<long>, firsts array<int>, lasts array<int>, places array<int>")


def stretches(held: DataFrame, length: int) -> DataFrame:
    """The stretch of every repeated anchor: ``deal`` key, row of the text, first start, bytes and ``again`` (known to repeat).

    Stretches that are equal within a share of a task go as one; the other places are rows of ``begins`` and ``ends``.
    """

    def cut(text: bytes, f: dict) -> Iterator[tuple[int, int, bytes]]:
        first, last = f["first"], f["last"]
        if f["n"] <= HOT:
            yield f["hash"], first, text[first : last + length]
            return
        # bands of the distance from start to anchor: equal strings are in equal bands, and the bytes that all
        # strings of a band share deal it
        for band in range((f["place"] - last) // BAND, (f["place"] - first) // BAND + 1):
            high = f["place"] - band * BAND
            low = high - BAND + 1
            core = text[high : low + length]
            deal = xxhash.xxh64_intdigest(core, seed=(f["hash"] + band) & (2**64 - 1))
            a, b = max(low, first), min(high, last)
            yield deal - 2**63, a, text[a : b + length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row per distinct stretch of the share; its other places are known repeats and go as spans of their text
        seen, known, size, places = {}, {}, 0, 0
        for batch in batches:
            texts = batch.column("text")
            for row, text, found in zip(batch.column("row").to_pylist(), texts, batch.column("found")):
                text = (text.as_py() or "").encode()
                for f in found.as_py():
                    for deal, first, body in cut(text, f):
                        own = seen.get((deal, body))
                        if own is None:
                            seen[deal, body] = [row, first, False]
                            size += len(body)
                            continue
                        own[2] = True
                        known.setdefault(row, []).append((first, first + len(body)))
                        places += 1
                if size > SHARE or places > SHARE // 64:
                    yield from made(seen, known)
                    seen, known, size, places = {}, {}, 0, 0
        yield from made(seen, known)

    def made(seen: dict, known: dict) -> Iterator[pa.RecordBatch]:
        rows = [(deal, row, first, body, again, None, None) for (deal, body), (row, first, again) in seen.items()]
        for row, found in known.items():
            begins, ends = zip(*united(*zip(*found)))
            rows.append((xxhash.xxh64_intdigest(f"{row} {begins[0]}") - 2**63, row, None, None, None, begins, ends))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 5000]), kinds)], names=["deal", "row", "first", "body", "again", "begins", "ends"])

    return map_arrow(held, run, "deal long, row long, first int, body binary, again boolean, begins array<int>, ends array<int>")


def sort_block(groups: list[dict[bytes, list]], length: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Spans (row, begins, ends) of the repeated strings of some anchors; a group maps each stretch to its places.

    A place is (row, first, again); a stretch of several places, or of one marked ``again``, repeats as a whole.
    """
    whole = lambda places: len(places) > 1 or places[0][2]
    single = [(b, p) for g in groups if len(g) == 1 for b, p in g.items() if whole(p)]
    for body, places in single:
        for row, first, _ in places:
            yield row, [first], [first + len(body)]
    several = [(b, p) for g in groups if len(g) > 1 for b, p in g.items()]
    if not several:
        return
    data = np.frombuffer(b"".join(b for b, _ in several), np.uint8)
    sizes = np.array([len(b) for b, _ in several])
    base = np.cumsum(sizes) - sizes
    fit = sizes - length + 1
    owner = np.repeat(np.arange(len(several)), fit)
    starts = np.repeat(base - (np.cumsum(fit) - fit), fit) + np.arange(len(owner))
    again = repeated_starts(data, starts, length) | (np.array([whole(p) for _, p in several]))[owner]
    where = starts - base[owner]
    new = again.copy()
    new[1:] &= ~(again[:-1] & (owner[1:] == owner[:-1]))
    end = again.copy()
    end[:-1] &= ~(again[1:] & (owner[1:] == owner[:-1]))
    begins, ends, of = where[new], where[end] + length, owner[new]
    cut = np.searchsorted(of, np.arange(len(several) + 1))
    for i, (_, places) in enumerate(several):
        b, e = begins[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]]
        if len(b):
            for row, first, _ in places:
                yield row, (b + first).tolist(), (e + first).tolist()


def repeats(dealt: DataFrame, length: int) -> DataFrame:
    """``row, begins, ends`` of repeated strings; ``dealt`` is partitioned and sorted by ``deal``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, now, group = [], 0, None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(sort_block(groups, length))
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.int32())), pa.array([r[2] for r in part], pa.list_(pa.int32()))], names=["row", "begins", "ends"])

        for batch in batches:
            names = ("deal", "row", "first", "again")
            straight = batch.filter(pc.is_null(batch.column("body")))
            if straight.num_rows:
                yield straight.select(["row", "begins", "ends"])
            for deal, row, first, again, body in zip(*(batch.column(c).to_pylist() for c in names), batch.column("body")):
                if not body.is_valid:
                    continue
                if deal != now:
                    if group:
                        groups.append(group)
                    if size >= BLOCK:
                        yield from flush()
                        groups, size = [], 0
                    now, group = deal, {}
                body = body.as_py()
                places = group.get(body)
                if places is None:
                    group[body] = [(row, first, again)]
                    size += len(body)
                else:
                    places.append((row, first, again))
        if group:
            groups.append(group)
        yield from flush()

    return map_arrow(dealt, run, "row long, begins array<int>, ends array<int>")


def united(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(begins, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def spans(docs: DataFrame, length: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table, per distinct text with a repeat: ``sha``, ``begins`` and ``ends`` of repeated strings, or ``whole``."""
    with scratch() as keep:
        return keep(found_spans(docs, length, gram, id_col, text_col))


def found_spans(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    base = base.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    named = base.select("doc_id", "sha")
    groups = shared_table(named.groupBy(F.col("sha").alias("s")).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    extra = shared_table(named.join(groups, named["sha"] == groups["s"]).where(~F.col("doc_id").eqNullSafe(F.col("owner"))).select(F.col("doc_id").alias("_id"), "s"))
    few = small(extra)
    texts = base.join(few, base["doc_id"].eqNullSafe(few["_id"]) & (base["sha"] == few["s"]), "left_anti")
    found = shared_table(anchored(texts.select("sha", "text"), length, gram))
    often = shared_table(found.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    often = small(often, ANCHOR_ROWS)
    each = found.select("row", F.explode(F.arrays_zip("hashes", "firsts", "lasts", "places")).alias("x")).select("row", F.col("x.hashes").alias("hash"), F.col("x.firsts").alias("first"), F.col("x.lasts").alias("last"), F.col("x.places").alias("place"))
    # a text's own anchors, gathered again
    held = each.join(often, "hash").groupBy("row").agg(F.collect_list(F.struct("hash", "first", "last", "place", "n")).alias("found"))
    held = held.join(found.select("row", F.col("sha").alias("s2")), "row")
    body = texts.select("sha", "text").join(held, F.col("sha") == F.col("s2")).select("row", "text", "found")
    dealt = stretches(body, length).repartition("deal").sortWithinPartitions("deal")
    out = shared_table(repeats(dealt, length))
    per = out.groupBy("row").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    per = per.join(found.select("row", "sha"), "row").groupBy("sha").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))
    whole = groups.select(F.col("s").alias("sha"))
    none = F.array().cast("array<int>")
    table = per.join(whole, "sha", "left_anti").select("sha", "begins", "ends", F.lit(False).alias("whole")).union(whole.select("sha", none, none, F.lit(True)))
    return shared_table(table)


def remove(docs: DataFrame, length: int = 200, gram: int = GRAM, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and any of ``n_bytes, n_removed, n_spans, kept_sha256, kept`` (binary), ``removed`` (spans)."""
    kinds = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string()), "kept": ("binary", pa.binary()), "removed": ("array<array<int>>", pa.list_(pa.list_(pa.int32())))}
    table = spans(docs, length, gram, id_col, text_col)
    table = F.broadcast(table) if table.count() <= SPANS_ROWS else table  # rows hold spans
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))
    rows = base.join(table, base["_sha"] == table["sha"], "left").select("doc_id", "text", "begins", "ends", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("begins", "ends", "whole")]
            for text, begins, ends, whole in zip(batch.column("text"), *columns):
                body = text.as_py().encode()
                cut = [(0, len(body))] if whole else united(begins, ends) if begins else []
                at, kept = 0, []
                for a, b in cut:
                    kept.append(body[at:a])
                    at = b
                kept = b"".join(kept) + body[at:]
                row = {"n_bytes": len(body), "n_removed": len(body) - len(kept), "n_spans": len(cut), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "removed": [list(x) for x in cut]}
                out.append([row[o] for o in outputs])
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), kinds[o][1]) for o, c in zip(outputs, zip(*out)))], names=["doc_id", *outputs])

    return map_arrow(rows, run, "doc_id long, " + ", ".join(f"{o} {kinds[o][0]}" for o in outputs))
