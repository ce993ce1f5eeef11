"""Operators that SQL cannot express against plain versions, and long or deep inputs."""

import random
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import bpe, exact, html, langid, mixing, ring
from foldlake.llm.queries import MIX_WEIGHTS, tokenizer_path
from tests.llm.fixtures import result, tables

FIRST = lambda x: (x is not None, x)  # noqa: E731  nulls first


def test_mixing_equals_a_plain_queue(spark):
    docs = tables(spark)[0]
    got = mixing.mix(docs, MIX_WEIGHTS).collect()
    sizes = Counter()
    for r in got:
        if r.epoch == 0:
            sizes[r.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fair_targets([sizes[s] for s in names], [MIX_WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2.0)))
    queue = []
    for s in names:
        passed, served = 0, [r for r in got if r.source == s]
        assert all(r.target == targets[s] and r.source_size == sizes[s] for r in served)
        # each pass over a source in its own order, which only the hash decides
        for r in sorted(served, key=lambda r: (r.epoch, r._mix % mixing.FEWEST, r._mix, FIRST(r.doc_id), r.size, r._crc)):
            passed += r.size
            finish = passed / targets[s] if targets[s] else 0.0
            assert abs(finish - r.finish) < 1e-9 or Counter((x.doc_id, x.size, x._crc) for x in served)[r.doc_id, r.size, r._crc] > r.epoch + 1
            queue.append((r.finish, FIRST(s), r.epoch, r._mix, FIRST(r.doc_id), r.size, r._crc, r.chosen))
    taken, budget, want = 0, int(1.5 * sum(sizes.values())), Counter()
    for *row, _ in sorted(queue):
        taken += row[5]
        if taken <= budget:
            want[tuple(row)] += 1
    assert Counter(tuple(row) for *row, chosen in queue if chosen) == want
    copies = Counter()
    for *row, chosen in queue:
        copies[row[4][1], row[5]] += chosen
    out = Counter()
    for r in mixing.taken(mixing.mix(docs, MIX_WEIGHTS)).collect():
        assert r.size == 0 or r.taken % r.size == 0
        out[r.doc_id, r.size] += r.taken // r.size if r.size else copies[r.doc_id, r.size]
    assert {k: n for k, n in out.items() if n} == {k: n for k, n in copies.items() if n}


def test_ring_equals_a_plain_walk(spark):
    docs = spark.range(1500).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text"))
    at = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit("key"), "doc_id", F.lit(None))).collect()}
    got = {r.doc_id: (r.shard, r.slot) for r in ring.assign(docs, shards=5, vnodes=16).collect()}
    points, owner = ring.ring(5, 16)
    room, arcs, used, want = ring.bounds(1500, 5, 0.0), defaultdict(list), [0] * 5, {}
    for d in sorted(at, key=lambda d: (at[d], d)):
        arcs[next((i for i, p in enumerate(points) if p >= at[d]), 0)].append(d)
    for walk in (False, True):
        for a in sorted(arcs):
            for d in [d for d in arcs[a] if d not in want]:
                k = a
                while walk and used[owner[k]] == room[owner[k]]:
                    k = (k + 1) % len(points)
                if used[s := int(owner[k])] < room[s]:
                    want[d] = (s, used[s])
                    used[s] += 1
    assert got == want


def test_ring_without_ids(spark):
    docs = spark.createDataFrame([(None, "a")] * 50 + [(1, "a")] * 50, "doc_id long, text string")
    out = ring.assign(docs, shards=4).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [25] * 4
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(25)) for s in range(4))


def test_languages_equal_a_plain_version(spark, sf):
    def grams(text):
        marks = [1]
        for c in text.lower():
            code = 2 + (ord(c) if ord(c) < 0xF000 else 0xF000 + ord(c) % 0xFFD) if c.isalpha() else 1
            if code != 1 or marks[-1] != 1:
                marks.append(code)
        marks += [1] if marks[-1] != 1 else []
        for n in (1, 2, 3):
            for i in range(len(marks) - n + 1):
                w = marks[i : i + n]
                if 1 not in w[1:-1] and not (w[0] == 1 and w[-1] == 1):
                    value = n
                    for c in w:
                        value = value * 65536 + c
                    yield value

    def ranked(counts, top=300):
        return {code: k for k, (code, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(90)
    data = docs.collect()
    profiles = defaultdict(Counter)
    for r in data:
        if r.doc_id % 4 != 2 and r.lang is not None and r.text is not None:
            profiles[r.lang].update(grams(r.text))
    profiles = {x: ranked(c) for x, c in profiles.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, F.col("doc_id") % 4 != 2, {"doc_id": F.col("doc_id")}).collect()}
    for r in data:
        own = ranked(Counter(grams(r.text or "")))
        if not own:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        far = sorted((sum(abs(p[c] - k) if c in p else 300 for c, k in own.items()), x) for x, p in profiles.items())
        assert got[r.doc_id][0] == far[0][1]
        assert abs(got[r.doc_id][1] - (1 - far[0][0] / far[1][0])) < 1e-9


def test_trie_of_texts_that_share_a_long_prefix():
    rng = random.Random(1)
    lead = b"p" * 100_000
    texts = [lead + bytes(rng.randrange(256) for _ in range(50)) for _ in range(300)] + [lead[: k * 300] for k in range(300)]
    trie = exact.PatriciaTrie(budget=200_000)
    for k, t in enumerate(texts + texts[:50]):
        trie.add(t, k)
    assert trie.spills > 1
    assert {t: (b, n) for t, b, n in trie.owners()} == {t: (texts.index(t), 1 + (k < 50)) for k, t in enumerate(texts)}


def test_a_trie_stays_within_its_budget():
    """Short strings side by side, one long string among short ones, and a long prefix of all: the budget does not grow."""
    rng = random.Random(2)
    short = [rng.randbytes(rng.randrange(1, 12)) for _ in range(30_000)]
    long = [bytes([7]) * 500_000 + rng.randbytes(4) for _ in range(3)]
    for texts in (short, short[:5000] + long + short[5000:9000], long * 2 + [b"x"]):
        trie, most = exact.PatriciaTrie(budget=200_000), 0
        for k, t in enumerate(texts):
            trie.add(t, k)
            most = max(most, trie.used)
        assert trie.spills > 0 and trie.budget == 200_000 and most <= 200_000 + 103_000
        first = {}
        for k, t in enumerate(texts):
            first.setdefault(t, k)
        assert {t: b for t, b, _ in trie.owners()} == first and sum(n for *_, n in trie.owners()) == len(texts)


def test_exact_dedup_in_rounds(spark):
    """A budget that spills most texts gives what a large one gives."""
    docs = tables(spark)[0]
    assert result(exact.exact_dedup(docs, budget=6000)) == result(exact.exact_dedup(docs))


def test_long_words():
    from tokenizers import Tokenizer

    t, b, rng = Tokenizer.from_file(tokenizer_path()), bpe.WordBpe(tokenizer_path()), random.Random(2)
    for word in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß漢") for _ in range(100_000)), "a" * 100_000):
        began = time.time()
        ids = np.frombuffer(b.encode_many([word])[0], "<u4").tolist()
        assert time.time() - began < 20
        assert ids == t.encode(word, add_special_tokens=False).ids


def plain_table(rows):
    """Cells of one line each, without spans: columns as wide as their widest cell."""
    wide = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows)))]
    return "\n".join(" | ".join(x.ljust(wide[k]) for k, x in enumerate(r)).rstrip() for r in rows)


def test_tables_against_a_plain_layout():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcxyz") for _ in range(rng.randrange(1, 9)))
    for _ in range(40):
        grid = [[word() for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 7))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{x}" + rng.choice(["", "</td>"]) for x in r) + rng.choice(["", "</tr>"]) for r in grid) + "</table>"
        assert html.visible_text(page) == plain_table(grid)


def test_nested_and_spanning_tables():
    assert html.visible_text("<table><tr><td>a<td>" * 50 + "x" + "</table>" * 50) == " | ".join(["a"] * 50 + ["x"])
    assert html.visible_text("<table><tr><td>" * 3000 + "x") == "x"
    spans = html.visible_text("<table><tr><td rowspan=2>both<td colspan=2>wide cell here<tr><td>a<td>b<tr><td>1<td>2<td>3</table>")
    assert spans == "both | wide cell here\n     | a | b\n1    | 2 | 3"
    assert html.visible_text("<table><tr><td colspan=3>1<td>x<tr><td>a<td>b<td>c<td>y</table>") == "1         | x\na | b | c | y"
    assert html.visible_text("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>") == "s\nt\nyes"


HOSTILE = {
    "wide cells": "<table>" + "<tr><td colspan=1000>a<td colspan=1000>b" * 6000,
    "wide row": "<table><tr>" + "<td colspan=1000>a" * 12_000,
    "cells to the end": "<table>" + "<tr><td rowspan=0>x<td>y" * 10_000,
    "bullets": "<ul><li>a" * 27_000,
    "numbers": "<ol><li>a" * 27_000,
    "paragraph outside of a button": "<p><button>" + "<div>" * 50_000 + "x",
    "end tags kept by a cell": "<b><table><td>" + "<i>" * 30_000 + "</b>" * 30_000 + "x",
    "long line": "<b>a</b> " * 27_000,
    "quotes": "<blockquote>a" * 20_000,
    "one long cell": "<table><tr><td>" + "x" * 50_000 + "<td>b" + "<tr><td>a<td>b" * 14_000,
    "nested": "<table><tr><td>a<td>" * 10_000,
    "a long cell beside many": "<table><tr>" + "<td>a" * 1000 + "<td>" + "b<br>" * 40_000,
    "items": "<li>" * 60_000 + "x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_end_soon_with_texts_of_their_order(name):
    page, began = HOSTILE[name], time.time()
    text = html.visible_text(page)
    assert text and len(text) < 60 * len(page) and time.time() - began < 30
    assert max(map(len, text.split("\n"))) <= len(page)


def test_uncovered_columns_have_no_width():
    assert html.visible_text("<table><tr><td colspan=1000>a<td>b<tr><td>c<td colspan=999>d<td>e</table>") == "a     | b\nc | d | e"
    deep = html.visible_text("<ul><li>" * 200 + "x")
    assert deep == " " * (html.INDENT - 2) + "- x"


def plain_text(page):
    """Text of pages made of paragraphs, breaks and lists only."""
    out = []
    for kind, words in page:
        out.append({"p": " ".join(words), "br": "\n".join(words), "ul": "\n".join("- " + w for w in words), "ol": "\n".join(f"{i + 1}. {w}" for i, w in enumerate(words))}[kind])
    return "\n\n".join(out)


def test_pages_against_plain_text():
    rng = random.Random(6)
    for _ in range(40):
        page = [(rng.choice(["p", "br", "ul", "ol"]), [rng.choice(["ab", "cd", "ef"]) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 5))]) for _ in range(rng.randrange(1, 6))]
        made = ""
        for kind, words in page:
            if kind == "p":
                made += "<p>" + " \n\t".join(words) + rng.choice(["", "</p>"])
            elif kind == "br":
                made += "<p>" + "<br>".join(words) + "</p>"
            else:
                made += f"<{kind}>" + "".join(f"<li>{w}" + rng.choice(["", "</li>"]) for w in words) + f"</{kind}>"
        assert html.visible_text(made) == plain_text(page)


def test_wide_characters_take_two_columns():
    assert html.width("漢a" + unicodedata.normalize("NFD", "é")) == 4


def test_clashing_columns_of_pages_and_turns(spark):
    from foldlake.llm import chat

    pages = spark.createDataFrame([(1, "<p>x", "t", 9)], "page_id long, html string, text string, n_chars int")
    assert [tuple(r) for r in html.extract(pages, outputs=("text", "n_chars")).collect()] == [(1, "x", 1)]
    turns = [(0, 0, "user", "hi", 1, "z"), (0, 1, "assistant", "yes", 1, "z"), (1, 0, "user", "ho", 1, "z"), (1, 1, "assistant", "no", 1, "z")]
    clash = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pair_id int, side string")
    out = chat.preferences(chat.pair_replies(clash))
    one = {r.pair_id: r for r in chat.examples(out).collect()}
    assert one[0].n_prompt_turns == 1 and "yes" in one[0].chosen and "no" in one[0].rejected and len(one[0].rejected_spans) == 1
    hard = spark.createDataFrame([(None, 1, "assistant", "a"), (4, None, None, None), (5, 3, "assistant", None), (5, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.examples(chat.preferences(chat.pair_replies(hard))).collect()}
    assert set(got) == {None, 4, 5} and got[None].rejected == "" and "b" in got[4].rejected and got[4].n_prompt_turns == 1
    assert chat.preferences(chat.pair_replies(hard.limit(0))).count() == 0


def test_pipeline_on_columns_of_any_type(spark):
    import corpus_pipeline

    extra = spark.createDataFrame(tables(spark)[0].collect(), tables(spark)[0].schema).select("*", F.create_map(F.lit("k"), "source").alias("m"), F.array(F.struct(F.create_map(F.lit(1), "lang"))).alias("deep"), F.struct("text").alias("s"), F.parse_json(F.lit("{}")).alias("v"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, "")
        assert out.schema.simpleString() == extra.schema.simpleString(), name
        assert out.count() == stage(spark, extra.select("doc_id", "text", "lang", "source", "n_chars"), "").count(), name


def test_pipeline_on_hard_rows(spark):
    import corpus_pipeline

    plain, empty, clash = tables(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0, name
        out = stage(spark, clash, "")
        assert out.columns == clash.columns
        assert result(out.select(*plain.columns)) == result(stage(spark, plain, "")), name


