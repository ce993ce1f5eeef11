"""Published vectors, round trips and properties of the byte-level functions."""

import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from foldlake.functions import chunking, crypto, encoding
from foldlake.functions.digest import blake3
from foldlake.operators import merkle


def test_blake3_of_nothing():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


def test_gear_table_and_masks():
    gear = chunking.gear()
    assert [f"{int(gear[i]):016X}" for i in (0, 1, 2, 255)] == ["C0E16B163A85A4DC", "890ACD8DD443C47C", "B3889D8A6DC47761", "FD4CBB1B3007D376"]
    assert (chunking.MASK_S.bit_count(), chunking.MASK_L.bit_count()) == (22, 18)


def slow_boundaries(data, p):
    gear, at = [int(x) for x in chunking.gear()], 0
    while at < len(data):
        left = len(data) - at
        cut = left
        if left > p.minimum:
            cut, fp = min(left, p.maximum), 0
            normal = min(left, p.average)
            for i in range(p.minimum, cut):
                fp = ((fp << 1) + gear[data[at + i]]) & (2**64 - 1)
                if fp & (p.mask_s if i < normal else p.mask_l) == 0:
                    cut = i
                    break
        yield at, cut
        at += cut


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 60_000])
def test_chunks_equal_byte_by_byte_form(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert list(chunking.boundaries(data, chunking.TEXT)) == list(slow_boundaries(data, chunking.TEXT))


def test_most_chunks_survive_an_insertion():
    data = np.random.default_rng(5).integers(0, 256, 1 << 20, dtype=np.uint8).tobytes()
    ids = lambda d: {d[a : a + n] for a, n in chunking.boundaries(d, chunking.TEXT)}
    before, after = ids(data), ids(data[:3000] + b"x" * 100 + data[3000:])
    assert len(before & after) >= 0.85 * len(before)


def test_identity_and_vector_bytes():
    tag = encoding.IDENTITY_DOMAIN
    assert encoding.identity_bytes(0, "a", 0o644, "", []) == tag + bytes.fromhex("01000161000000")
    assert encoding.identity_bytes(0, "f", 0, "", [(b"\xab" * 32, 1024)]) == tag + bytes.fromhex("01000166000001") + b"\xab" * 32 + bytes.fromhex("8008")
    assert encoding.encode_vector({"a": 1}).hex() == "01016101"
    assert encoding.encode_vector({"b": 2, "a": 1, "z": 0}).hex() == "02016101016202"


@given(st.dictionaries(st.text(max_size=8), st.integers(1, 2**63)))
def test_vectors_round_trip(vector):
    assert encoding.decode_vector(encoding.encode_vector(vector)) == vector
    with pytest.raises(ValueError):
        encoding.decode_vector(encoding.encode_vector(vector) + b"\0")


@given(st.lists(st.tuples(st.integers(0, 2), st.text(max_size=9), st.integers(0, 0o7777), st.text(max_size=5), st.lists(st.tuples(st.binary(min_size=32, max_size=32), st.integers(0, 2**40)), max_size=3)), max_size=6))
def test_catalogs_round_trip(entries):
    assert encoding.decode_catalog(encoding.encode_catalog(entries)) == sorted(entries, key=lambda e: e[1].encode())


@given(st.binary(min_size=1, max_size=64))
def test_recovery_codes_round_trip(secret):
    assert encoding.read_recovery_code(encoding.recovery_code(secret)) == secret


def test_hkdf_rfc5869_case_1():
    out = crypto.hkdf(b"\x0b" * 22, bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42, bytes.fromhex("000102030405060708090a0b0c"))
    assert out.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 4097])
def test_merkle_root_equals_one_list(spark, n):
    rows = [(f"p{i:05d}", hashlib.sha256(str(i).encode()).hexdigest(), i % 3 == 0) for i in range(n)]
    got = merkle.root(spark.createDataFrame(rows, "path string, manifest_id string, deleted boolean")).first()
    hashes = [merkle.leaf_hash(p, bytes.fromhex(m), d) for p, m, d in rows]
    assert got["root"] == (merkle.reduce_level(hashes) if rows else merkle.empty_root()).hex()
    assert got["leaves"] == n


def leaf_rows(paths, salt=""):
    return [(p, hashlib.sha256(f"{p}{salt}".encode()).hexdigest(), len(p) % 3 == 0) for p in paths]


def plain_root(rows):
    return merkle.reduce_level([merkle.leaf_hash(p, bytes.fromhex(m), d) for p, m, d in sorted(rows)]).hex()


def test_trees_grow_by_changes_and_differ_by_descent(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    schema = "path string, manifest_id string, deleted boolean"
    rows = {p: (p, m, d) for p, m, d in leaf_rows([f"p{k:03d}" for k in range(100)])}
    tree = merkle.planted(spark.createDataFrame(list(rows.values()), schema))
    assert tree.roots().first()["root"] == plain_root(rows.values()) and [x.count() for x in tree.levels] == [25, 7, 2, 1]

    def step(changes, most):
        """Blocks hashed again per level, at most so many; the root is that of all rows, the diff is what has changed."""
        nonlocal tree
        before = dict(rows)
        rows.update({p: (p, m, d) for p, m, d in changes})
        old, (tree, hashed) = tree, merkle.grown(tree, spark.createDataFrame(changes, schema))
        assert tree.roots().first()["root"] == plain_root(rows.values())
        assert all(a <= b for a, b in zip(hashed, most)) and len(hashed) == len(most), hashed
        assert sorted(r["path"] for r in merkle.changed(old, tree).collect()) == sorted(p for p in rows if rows[p] != before.get(p))
        if len(hashed) > 4:
            whole = merkle.planted(spark.createDataFrame(list(rows.values()), schema))
            key = lambda t: [sorted(map(tuple, x.select("i", "h").collect())) for x in (t.leaves, *t.levels)]
            assert key(whole) == key(tree)
        return [x.count() for x in merkle.unequal(old, tree)]

    assert step(leaf_rows(["p050"], "a"), [1, 1, 1, 1]) == [4, 4]
    assert step(leaf_rows(["p003", "p097", "p098"], "b"), [2, 2, 2, 1]) == [8, 8]
    assert step(leaf_rows(["p010"]), [0, 0, 0, 0]) == [0, 0]  # as it was
    step(leaf_rows(["p0900", "zz", "p020"], "c"), [5, 3, 2, 1])  # new paths move those behind them
    step(leaf_rows([f"z{k:03d}" for k in range(300)], "d"), [77, 21, 7, 2, 1])
    assert step(leaf_rows(["a"], "e"), [101, 26, 7, 2, 1])[0] == 402


def test_trees_of_groups_and_of_nothing(spark):
    rows = [(g, *x) for g, n in (("a", 1), ("b", 300), ("c", 17)) for x in leaf_rows([f"{g}{k:03d}" for k in range(n)])]
    df = spark.createDataFrame(rows, "folder string, path string, manifest_id string, deleted boolean")
    want = {g: plain_root([r[1:] for r in rows if r[0] == g]) for g in "abc"}
    assert {r["folder"]: r["root"] for r in merkle.roots(df, "folder").collect()} == want
    tree = merkle.planted(df, "folder")
    assert {r["g"]: r["root"] for r in tree.roots().collect()} == want
    assert merkle.changed(tree.of("a"), tree.of("c")).count() == 18
    empty = merkle.planted(df.limit(0).drop("folder"))
    grown, _ = merkle.grown(empty, df.where("folder = 'c'"))
    assert grown.roots().first()["root"] == want["c"]
