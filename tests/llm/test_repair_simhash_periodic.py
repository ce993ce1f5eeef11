"""Conversation repair, SimHash classes and periodic runs against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from foldlake.llm import periodic, repair, simhash
from foldlake.llm.queries import oracle_sql, queries
from tests.llm.fixtures import DOCS, result, rows as hard_rows, tables
from tests.test_catalog import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repair(initials, faults):
    """Least (cost, audit) by Dijkstra over single edits."""
    heap, seen = [(0, "", 0, "-")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(initials) and last in "-a":
            return cost, audit
        follows = {"-": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", i, role))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                if initials[i] in follows:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i]))
                for role in follows.replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role))


def test_repair_equals_single_edits():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(0, 14)
        initials = "".join(rng.choice(rng.choice(["ua", "sua", "sua-", "s", "a"])) for _ in range(n))
        faults = "".join(rng.choice("....tbd") for _ in range(n))
        assert repair.repair(initials, faults) == plain_repair(initials, faults), (initials, faults)


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 9, "user", "Hi?"), (2, None, None, None), (2, 5, "tool", "x" * 200_000), (2, 5, "Assistant", "ok!"),
    (None, 1, "user", "who?"), (None, None, "user", " \t"), (3, 3, "assistant", "漢字。"), (3, 4, "user", "漢字! "), (4, 1, "", ""), (4, 2, "user", "\n\x0b\x1f"), (5, 7, "s", "?"), (5, 8, "user", "a\nb."), (5, 8, "user", "a\nb"),
    *[(6, t % 50, "user" if t % 3 else "assistant", f"turn {t % 70}.") for t in range(700)], *[(7 + t, 1, "user", "q?") for t in range(60)],
]


@pytest.mark.parametrize("clash", [False, True])
def test_hard_conversations_equal_sql(spark, tmp_path, monkeypatch, clash):
    monkeypatch.setattr(repair, "ROWS", 16)
    schema = "conv_id long, turn long, role string, text string" + ", conv string, part int, fault string, sha string, _k int" * clash
    spark.createDataFrame([(*t, *("x", 1, "y", "z", 2) * clash) for t in TURNS], schema).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries()["op11_retained"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(oracle_sql()["op11_retained"]).df())
    assert len(got) == len({t[0] for t in TURNS})


def test_repaired_lines(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "a."), (1, 1, "user", "b?"), (1, 2, "user", "b?"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in repair.lines(turns).collect()) == [(1, 0, ["user:", "assistant:a.", "user:b?", "assistant:"]), (2, 0, [])]
    found = {r.conv_id: r for r in repair.repaired(turns).collect()}
    assert found[1].audit == "IKKDI" and found[1].repaired_sha256 == hashlib.sha256(b"user:\nassistant:a.\nuser:b?\nassistant:").hexdigest()
    assert repair.report(turns.limit(0), turns.limit(0)).count() == 0


def plain_print(text, words=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    made = [" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius):
    """Component (as its least member) of every fingerprint, by all pairs."""
    x = np.array(sorted(prints), np.uint64)
    own = np.arange(len(x))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= radius) for v in x]
    while True:
        new = np.array([own[k].min() for k in near])
        if np.array_equal(new, own):
            return {int(v): int(x[c]) for v, c in zip(x, own)}
        own = new


def test_fingerprints_and_classes_of_documents(spark):
    docs = tables(spark)[0]
    prints = [(r[0], plain_print(r[1])) for r in hard_rows()]
    parts = plain_classes({p for _, p in prints}, 4)
    least = {}
    for doc, p in prints:
        c = parts[p]
        least[c] = doc if least.get(c) is None else least[c] if doc is None else min(doc, least[c])
    want = Counter((doc, p - (1 << 64) * (p >> 63), least[parts[p]]) for doc, p in prints)
    assert Counter(map(tuple, simhash.link(docs, words=4).collect())) == want
    assert simhash.link(tables(spark)[1]).count() == 0


@pytest.mark.parametrize("tree, shard, radius", [(1024, 64, 4), (24, 64, 4), (40, 1e-6, 2)])
def test_classes_equal_all_pairs(spark, monkeypatch, tree, shard, radius):
    """Clusters, chains and unrelated fingerprints; small trees make shards of many."""
    monkeypatch.setattr(simhash, "TREE", tree), monkeypatch.setattr(simhash, "SHARD", shard), monkeypatch.setattr(simhash, "PAIRS", 500)
    rng = random.Random(9)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    prints = {0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(150))}
    for spread in (2, 5, 9):
        base = rng.getrandbits(64)
        prints |= {flip(base, rng.randrange(spread + 1)) for _ in range(180)}
    chain = rng.getrandbits(64)
    for _ in range(60):
        prints.add(chain := flip(chain, rng.randrange(1, 6)))
    want = plain_classes(prints, radius)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    got = {r[0] % (1 << 64): r[1] for r in simhash.classes(df, radius).collect()}
    groups, plain = {}, {}
    for p in prints:
        groups.setdefault(got.get(p, simhash.signed(p)), set()).add(p)
        plain.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def plain_runs(x, least=24, times=3):
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            top = j + q
            if j > i and top - i >= max(least, times * q) and not any(all(x[k] == x[k + d] for k in range(i, top - d)) for d in range(1, q)):
                out.append((i, top - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    k, x = rng.choice([1, 2, 2, 3, 5, 30]), []
    for _ in range(rng.randrange(1, 12)):
        if rng.random() < 0.6:
            base = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
            base = base * rng.randrange(1, 6) + [rng.randrange(k)] if rng.random() < 0.3 else base
            x += (base * rng.randrange(1, 12))[: rng.randrange(1, 200)]
        else:
            x += [rng.randrange(k) for _ in range(rng.randrange(1, 30))]
    return x[:500]


def test_runs_equal_a_plain_search():
    rng, found = random.Random(5), 0
    for _ in range(400):
        x = periodic_words(rng)
        want = plain_runs(x)
        assert periodic.runs(np.array(x)) == want, x
        found += len(want)
    assert found > 300


@pytest.mark.parametrize("x", [[0] * 100_000, ([0] * 30 + [1]) * 3000, [k % 401 for k in range(100_000)], [(k * k) % 1009 for k in range(100_000)]])
def test_long_periodic_texts_end_soon(x):
    low, length, q = max(periodic.runs(np.array(x)), key=lambda r: r[1])
    assert all(x[k] == x[k + q] for k in range(low, low + length - q)) and length > 90_000


def test_hard_documents_equal_sql(spark, tmp_path):
    rng = random.Random(8)
    more = [(100 + k, " ".join(f"w{v}" for v in periodic_words(rng)), "en", "p", 0) for k in range(120)]
    more += [(next(d for d in range(1000 * k, 10**6) if zlib.crc32(str(d).encode()) % 10 == 0), " ".join(f"w{rng.randrange(30)}" for _ in range(n)), "en", "p", 0) for k, n in enumerate((1, 2, 5, 24, 90, 400, 3000), 1)]
    spark.createDataFrame(hard_rows() + more, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries()["op13_blocks"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(oracle_sql()["op13_blocks"]).df())
    assert (got["n_runs"] > 0).sum() > 50


def test_new_operators_on_clashing_columns(spark):
    plain, empty, clash = tables(spark)
    keys = {"doc_id": clash["doc_id"]}
    assert result(periodic.digest(periodic.find(clash, keys))) == result(periodic.digest(periodic.find(plain, {"doc_id": plain["doc_id"]})))
    assert result(simhash.link(clash)) == result(simhash.link(plain))
    assert periodic.digest(periodic.find(empty, {"doc_id": empty["doc_id"]})).count() == 0
