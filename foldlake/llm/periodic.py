"""Periodic runs of words: blocks matched within a document, matches extended exactly.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``times`` periods and
``least`` words long, that no neighbouring word extends.  It is found at the scale B, the power of two with B <= q < 2B: a
stretch of 3q words holds an aligned block of B words, and the same block again q words later.

* At each scale the aligned blocks are the keys of an automaton over integer sequences, which is searched across the words after
  them; of its matches those count whose distance to an equal aligned block fits the scale.  A match at o has one such block at most.
* Each match seeds an exact extension to both sides with the distance as period; a stretch that is long enough is a run if no
  period q / prime holds for it.

Blocks and search go over segments of a document, so an automaton holds some 1,000 words or four blocks and not a whole text.
Three tests leave out what cannot be a new run, each by proof:

* in a run of period q every word but the first q has the same word less than 2B words before it, so a scale looks only at
  stretches of such words that are long enough;
* block and match inside one known run of a period p < B: p divides q, the run found would be the known one;
* a block inside a known run of period p <= B / 3: unless block and match are as before, a run of period q maps the start or the end of
  that run to the start or the end of the run that holds the match.  So these blocks stay out of the automaton, whose failure links
  would lead through all their borders, and the first and last of them are compared where the other runs of period p begin and end.

Without the last two a text of one repeated word would cost the square of its length.

Defined cases: null and empty texts have no words and no runs; whole texts are read, of any length; rows with a null or a
repeated id are rows like others; an empty table gives no rows; columns but the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import map_arrow, slices

#: Words of the blocks in one automaton; a node looks through its branches one by one, so a small root is a fast one.
SEGMENT = 1024


def repeats(ids: np.ndarray) -> np.ndarray:
    """Distance of every word to the same word before it; more than all words if there is none."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    gap = np.full(len(ids), 1 << 40)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    return gap


def stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal ranges of set flags of at least that length."""
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins >= least
    return list(zip(begins[long].tolist(), ends[long].tolist()))


def seeds(words: list[int], low: int, high: int, block: int, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Aligned blocks in a range of words, but those at home in a run, and where each is met again ``block`` to ``2 * block - 1`` words later."""
    own, met = [], []
    step = max(SEGMENT // block, 4) * block
    for first in range(-(-low // block) * block, high - 2 * block + 1, step):
        automaton, number, keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, []
        for b in range(first, min(first + step, high - 2 * block + 1), block):
            if home[b]:
                keys.append(-1)
                continue
            key = tuple(words[b : b + block])
            if key not in number:
                number[key] = len(number)
                automaton.add_word(key, number[key])
            keys.append(number[key])
        if not number:
            continue
        automaton.make_automaton()
        base, last = first + block, first + (len(keys) - 1) * block
        hits = list(automaton.iter(tuple(words[base : min(high, last + 3 * block - 1)])))
        if hits:
            at, key = np.array(hits).T
            at = at + base - block + 1
            b = (at - block) // block * block
            fits = (b >= first) & (b <= last)
            fits[fits] = np.array(keys)[(b[fits] - first) // block] == key[fits]
            own.append(b[fits])
            met.append(at[fits])
    return (np.concatenate(own), np.concatenate(met)) if own else (np.zeros(0, np.int64),) * 2


def extend(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """First place from ``at`` on (to the right for step 1, to the left for -1) whose word differs from the one a period back."""
    n, part = len(ids), 64
    while 0 <= at < n:
        if step > 0:
            to = min(n, at + part)
            differ = ids[at:to] != ids[at - period : to - period]
        else:
            to = max(-1, at - part)
            differ = (ids[to + 1 : at + 1] != ids[to + 1 + period : at + 1 + period])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at + step * k
        at, part = to, part * 2
    return at


def primes(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start and period.  ``times`` is 3 or more, as the scales rest on it."""
    n, found = len(ids), set()
    if n < least:
        return []
    gap, words, block = repeats(ids), None, 1
    reach = np.zeros(n + 1, np.int64)
    while times * block <= n:
        near = gap < 2 * block
        need = max((times - 1) * block, least + 1 - 2 * block)
        areas = stretches(near, need) if int(near.sum()) >= need else []
        if areas:
            words = ids.tolist() if words is None else words
            home, more = homes(ids, found, block)
        done: dict[int, tuple[int, int]] = {}
        for begin, high in areas:
            own, met = seeds(words, max(0, begin - 2 * block + 1), high, block, home)
            own, met = np.concatenate([more[0], own]), np.concatenate([more[1], met])
            more = np.zeros((2, 0), np.int64)
            new = reach[own] < met + block
            own, met = own[new], met[new]
            for b, o in zip(own.tolist(), met.tolist()):
                q = o - b
                low, top = done.get(q, (0, 0))
                if low <= b and o + block <= top:
                    continue
                low, top = extend(ids, b - 1, q, -1) + 1, extend(ids, o + block, q, 1)
                done[q] = low, top
                if top - low >= max(least, times * q) and not any(np.array_equal(ids[low + q // p : top], ids[low : top - q // p]) for p in primes(q)):
                    found.add((low, top - low, q))
        for low, length, _ in found:
            reach[low] = max(reach[low], low + length)
        if found:
            np.maximum.accumulate(reach, out=reach)
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def homes(ids: np.ndarray, found: set[tuple[int, int, int]], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose block lies in a known run of a period of at most a third of it, and the seeds (block, match) of such blocks."""
    home, by_period, pairs = np.zeros(len(ids), bool), {}, []
    for low, length, q in sorted(found) if block >= 32 else []:
        if 3 * q <= block <= length:
            home[low : low + length - block + 1] = True
            by_period.setdefault(q, []).append((low, low + length))
    for ends in by_period.values():
        lows, tops = np.array(ends).T
        for low, top in ends:
            first, last = -(-low // block) * block, (top - block) // block * block
            for at, of, others in ((first, low, lows), (last, top, tops)):
                if low <= at <= top - block:
                    # such runs overlap by less than two periods: a few begin or end at these distances
                    fit = others[np.searchsorted(others, of + block) : np.searchsorted(others, of + 2 * block)]
                    pairs += [(at, at + q) for q in (fit - of).tolist() if np.array_equal(ids[at : at + block], ids[at + q : at + q + block])]
    return home, np.array(pairs, np.int64).reshape(-1, 2).T


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def find(docs: DataFrame, keys: dict[str, Column], text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None, least: int = 24, times: int = 3) -> DataFrame:
    """Per row: ``keys``, ``runs`` (start, length, period by start and period) and ``collapsed``: the words that no run holds beyond its first period.

    ``edit``, if given, changes the list of words before the search; it is told the first key.
    """
    source = docs.select(F.col(text_col).alias("_text"), *(c.alias(k) for k, c in keys.items()))
    fields = source.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "_text"):
                ids, all_runs, texts = part.column(1).to_pylist(), [], []
                for key, text in zip(ids, part.column("_text").cast(pa.binary()).to_pylist()):
                    words = (text or b"").split()  # at space and 0x09 to 0x0D
                    if edit:
                        words = edit(key, words)
                    own = runs(numbered(words), least, times) if len(words) >= least else []
                    keep = np.ones(len(words), bool)
                    for start, length, period in own:
                        keep[start + period : start + length] = False
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    texts.append(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()] if own else words).decode())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(all_runs, struct), pa.array(texts, pa.string())], names=[*part.schema.names[1:], "runs", "collapsed"])

    return map_arrow(source, run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document of the registered query: one id in ten repeats a stretch to its end.  A null id repeats nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest(found: DataFrame) -> DataFrame:
    """One row per document: count of runs, the one of the greatest exponent, digests of all runs and of the collapsed text."""
    # a * d > c * b compares a / b and c / d exactly
    better = lambda r, b: (b["period"].isNull()) | (r["length"] * b["period"] > b["length"] * r["period"]) | ((r["length"] * b["period"] == b["length"] * r["period"]) & (F.struct(r["start"], r["period"]) < F.struct(b["start"], b["period"])))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | better(r, b), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
