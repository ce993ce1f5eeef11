"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams (1 to ``longest``, words padded by a mark) in
order of frequency.  A document's own most frequent n-grams are compared with each profile by the out-of-place
distance: the sum over its n-grams of the difference in rank, with the largest difference for absent ones.  The
nearest profile names the language; ties go to the first in code point order.

Profiles are learned from at most about ``sample_per_lang`` documents of each language, picked by a hash of the text (a
documented bound for fitting only); prediction covers every whole text.

Defined cases: null texts and texts without a letter give ``und`` with score 0; rows without a language teach
nothing; with no teaching row every prediction is ``und``; repeated rows get a row each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import map_arrow

#: Bits of a character in an n-gram code; code points are folded into them by a hash.
BITS = 16
MARK = 1


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code of every character (MARK for all that are not letters, runs of marks once) and the text of each."""
    lower = [t.lower() for t in pc.fill_null(texts, "").to_pylist()]
    chars = np.frombuffer("\0".join(lower).encode("utf-32-le"), np.uint32)
    points, back = np.unique(chars, return_inverse=True)
    table = np.array([(MARK if not chr(p).isalpha() else 2 + (p if p < 0xF000 else 0xF000 + p % 0xFFD)) for p in points.tolist()], np.int64) if len(points) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])[: len(chars)]
    return table[back] if len(points) else np.zeros(0, np.int64), owner


def grams(texts: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams and the index of the text of each; an n-gram holds no mark but at its ends."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, doc = letters(texts)
    code, doc = np.concatenate([[MARK], code, [MARK]]), np.concatenate([[0], doc, [len(texts) - 1]])
    keep = np.ones(len(code), bool)
    keep[1:] = ~((code[1:] == MARK) & (code[:-1] == MARK) & (doc[1:] == doc[:-1]))
    code, doc = code[keep], doc[keep]
    mark = code == MARK
    out, of = [], []
    for n in range(1, longest + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        value = np.full(m, n, np.int64)
        good = np.ones(m, bool)
        for k in range(n):
            value = value * (1 << BITS) + code[k : k + m] if n <= 3 else (value * np.int64(0x9E3779B1) + code[k : k + m])
            if 0 < k < n - 1:
                good &= ~mark[k : k + m]
        good &= ~(mark[:m] & mark[n - 1 : n - 1 + m])
        # a text's end is a mark of its own: an n-gram lies in the text of its first letter
        owner = np.where(mark[:m], doc[min(1, n - 1) : min(1, n - 1) + m], doc[:m])
        out.append(value[good])
        of.append(owner[good])
    return np.concatenate(out), np.concatenate(of)


def ranked(codes: np.ndarray, texts: np.ndarray, n: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, rank) of the ``top`` most frequent n-grams of each text; equal counts in order of code."""
    order = np.lexsort((codes, texts))
    codes, texts = codes[order], texts[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(codes)))
    codes, texts = codes[at], texts[at]
    order = np.lexsort((codes, -times, texts))
    codes, texts = codes[order], texts[order]
    rank = np.arange(len(codes)) - np.searchsorted(texts, np.arange(n))[texts]
    few = rank < top
    return texts[few], codes[few], rank[few]


def learn(docs: DataFrame, lang_col: str, text_col: str, top: int, longest: int, sample_per_lang: int) -> dict[str, np.ndarray]:
    """Profile (codes by rank) of every language among ``docs``."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {lang: n for lang, n in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.lit(None)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample_per_lang / n) * (1 << 31)))).otherwise(share)
    picked = known.where((F.shiftrightunsigned(F.xxhash64(F.lit("pick"), "text"), 33)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                part = batch.filter(pc.equal(batch.column(0), lang))
                for start in range(0, part.num_rows, 256):
                    codes, _ = grams(part.column(1).slice(start, 256), longest)
                    values, times = np.unique(codes, return_counts=True)
                    total.setdefault(lang, Counter()).update(dict(zip(values.tolist(), times.tolist())))
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["lang", "code", "n"])

    totals = map_arrow(picked, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = totals.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, top).alias("best"))
    # languages x top numbers
    return {r.lang: np.array([x.code for x in r.best], np.int64) for r in best.collect()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], passed: dict[str, Column], text_col: str = "text", top: int = 300, longest: int = 3) -> DataFrame:
    """The columns of ``passed``, ``lang_pred`` and ``score`` for every row.

    The score is the share by which the nearest profile beats the second: 1 - nearest / second distance, from 0 to 1.
    """
    names = sorted(profiles)
    keys = [np.sort(profiles[x]) for x in names]
    ranks = [np.argsort(profiles[x], kind="stable") for x in names]
    source = docs.select(*(c.alias(k) for k, c in passed.items()), F.col(text_col).alias("_text"))
    carried = list(passed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n = part.num_rows
                codes, owner = grams(part.column("_text"), longest)
                texts, codes, rank = ranked(codes, owner, n, top)
                has = np.bincount(texts, minlength=n) > 0
                far = np.zeros((len(names), n))
                for k, (sorted_codes, rank_of) in enumerate(zip(keys, ranks)):
                    at = np.minimum(np.searchsorted(sorted_codes, codes), max(len(sorted_codes) - 1, 0))
                    found = sorted_codes[at] == codes if len(sorted_codes) else np.zeros(len(codes), bool)
                    apart = np.where(found, np.abs(rank_of[at] - rank) if len(sorted_codes) else 0, top)
                    far[k] = np.bincount(texts, weights=apart, minlength=n)
                if names:
                    best = far.argmin(0)
                    two = np.sort(far, 0)[:2]
                    second = two[1] if len(names) > 1 else np.maximum(np.bincount(texts, minlength=n) * float(top), 1)
                    score = np.clip(1 - two[0] / np.maximum(second, 1e-9), 0, 1)
                pred = [names[best[i]] if names and has[i] else "und" for i in range(n)]
                sure = np.where(has, score, 0.0) if names else np.zeros(n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(sure.astype(float))], names=[*carried, "lang_pred", "score"])

    return map_arrow(source, run, schema)


def identify(docs: DataFrame, teach: Column, passed: dict[str, Column], lang_col: str = "lang", text_col: str = "text", top: int = 300, longest: int = 3, sample_per_lang: int = 2000) -> DataFrame:
    """Learn from the rows where ``teach`` holds and predict every row."""
    return predict(docs, learn(docs.where(teach), lang_col, text_col, top, longest, sample_per_lang), passed, text_col, top, longest)
