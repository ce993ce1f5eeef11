"""The pipeline against its stages done plainly."""

import hashlib

import numpy as np

import corpus_pipeline
from foldlake.llm import mixing
from foldlake.llm.queries import MIX_WEIGHTS, tokenizer_path
from tests.llm.fixtures import DOCS
from tests.llm.test_operators import WORD


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    assert first.columns == docs.columns
    kept = {}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {t for t in tri if tri.count(t) > 1} if len(tri) < 5000 else {t for t, n in __import__("collections").Counter(tri).items() if n > 1}
        covered = {i + k for i, t in enumerate(tri) if t in twice for k in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            kept[r.doc_id] = r.text
    assert {r.doc_id: r.text for r in first.collect()} == kept
    second = corpus_pipeline.exact_dedup(spark, first, sf)
    owner = {}
    for d in sorted(kept):
        owner.setdefault(kept[d], d)
    assert {r.doc_id for r in second.collect()} == set(owner.values())
    third = corpus_pipeline.near_dedup(spark, second, sf)
    ids = sorted(owner.values())
    sets = {d: {tuple(w[i : i + 5]) for w in [WORD.findall(kept[d].lower())] for i in range(len(w) - 4)} for d in ids}
    part = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if v == old else v for k, v in part.items()}
    assert {r.doc_id for r in third.collect()} == set(part.values())
    fourth = corpus_pipeline.mix_sources(spark, third, sf)
    assert fourth.columns == docs.columns
    taken = {r.doc_id: r.taken // r.size for r in mixing.taken(mixing.mix(third, MIX_WEIGHTS)).collect() if r.taken}
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(d for d, n in taken.items() for _ in range(n))
    t = Tokenizer.from_file(tokenizer_path())
    for r in corpus_pipeline.tokens(spark, fourth, sf).limit(20).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(t.encode(kept[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert corpus_pipeline.run(spark, sf).count() == sum(taken.values())


def test_pipeline_decides_by_row(spark):
    import random
    from collections import Counter

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    row = lambda d, t, s="a": (d, t, "en", s, len(t))
    good, copied, near = [text(90) for _ in range(6)], text(90), text(200)
    edited = near + " end"
    docs = [row(None, t) for t in good] + [row(None, "too short"), row(7, "also short"), row(7, text(90)), row(1, copied), row(None, copied), row(2, copied, "b")]
    docs += [row(3, near), row(9, edited), row(9, text(90), "b"), row(8, near + " of it", "b")] + [row(None, near + " last")] + [row(5, good[0] + " x y z " + text(60))] * 2
    table = lambda r: spark.createDataFrame(r, DOCS)
    rows = lambda d: Counter(map(tuple, d.collect()))
    first = rows(corpus_pipeline.quality_rules(spark, table(docs), ""))
    assert first == Counter(r for r in docs if "short" not in r[1])
    second = rows(corpus_pipeline.exact_dedup(spark, table(list(first.elements())), ""))
    assert second == Counter({r: 1 for r in first if r[1] != copied or r[0] == 1})
    third = rows(corpus_pipeline.near_dedup(spark, table(list(second.elements())), ""))
    assert third == Counter({r: 1 for r in second if r[0] == 3 or not r[1].startswith(near)})
    assert rows(corpus_pipeline.near_dedup(spark, table(list(third) * 2), "")) == third
    for given in (list(third), list(third) * 2):
        mixed = mixing.mix(table(given), MIX_WEIGHTS).where("chosen").collect()
        fourth = rows(corpus_pipeline.mix_sources(spark, table(given), ""))
        assert sum(fourth.values()) == len(mixed) and set(fourth) <= set(given)
        assert all(n <= 2 * given.count(r) for r, n in fourth.items())
