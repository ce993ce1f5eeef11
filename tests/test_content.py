"""Content queries without SQL against plain Python over the same tables, and published digests."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldlake.functions import chunking, columns, crypto
from foldlake.functions.digest import blake3
from foldlake.plans import catalog
from tests.test_encodings import slow_boundaries

QUERIES = catalog.queries()


@pytest.mark.parametrize(
    "n, digest",
    [
        (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
        (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
        (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"),
        (2048, "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"),
    ],
)
def test_blake3_of_several_chunks(n, digest):
    assert blake3(bytes(i % 251 for i in range(n))).hex() == digest


def texts(spark, sf):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_chunks_of_documents(spark, sf):
    import hashlib

    want = {(d, i, at, n, hashlib.sha256(b[at : at + n]).hexdigest()) for d, b in texts(spark, sf).items() for i, (at, n) in enumerate(slow_boundaries(b, chunking.TEXT))}
    got = {tuple(r) for r in QUERIES["cdc_chunks"](spark, sf).select("doc_id", "ord", "offset", "length", "chunk_id").collect()}
    assert got == want
    once = {i: n for *_, n, i in want}
    assert tuple(QUERIES["cdc_dedup_ratio"](spark, sf).select("bytes", "stored_bytes", "chunks").first()) == (sum(n for *_, n, _ in want), sum(once.values()), len(once))


def test_smaller_of_raw_and_compressed(spark, sf):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    want = {d: (len(z), 1) if len(z) < len(b) else (len(b), 0) for d, b in texts(spark, sf).items() for z in [pack.compress(b)]}
    got = {r.doc_id: (r.bytes, r.codec) for r in QUERIES["compress_smaller"](spark, sf).collect()}
    assert got == {d: want[d] for d in got} and len(got) > 100


def test_keys_of_folders(spark, sf):
    import hashlib

    names = [r[0] for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_name").collect()]
    got = {r.n_name: r.verifier for r in QUERIES["folder_verifiers"](spark, sf).collect()}
    assert got == {n: crypto.verifier(hashlib.sha256(n.encode()).digest()).hex().upper() for n in names}
    keys = {r.n_name: r.key for r in QUERIES["passphrase_keys"](spark, sf).where(F.col("n_name") < "C").collect()}
    assert keys == {n: crypto.passphrase_key(n, hashlib.sha256(n.encode()).digest()).hex().upper() for n in names if n < "C"}


def test_sizes_beyond_a_terabyte_equal_sql(spark, tmp_path):
    """From a key of 100,000 on sizes reach 10**12, which the SQL writes in GB; the function writes TB unless told otherwise."""
    keys = [1, 3, 99_999, 100_000, 123_456, 899_999, 900_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = dict(con.execute(catalog.oracle_sql()["size_format"]).fetchall())
    assert {r["id"]: r["size"] for r in QUERIES["size_format"](spark, str(tmp_path)).collect()} == want
    assert want[100_000] == "1000.0GB"
    n = spark.createDataFrame([(10**12,), (10**12 - 10**9,)], "n long")
    assert [r[0] for r in n.select(columns.format_size(F.col("n"))).collect()] == ["1.0TB", "999.0GB"]


def test_batches_of_texts_are_bounded_by_bytes(spark, tmp_path):
    """A worker takes a few MB of long texts at a time, and not 10,000 rows of them."""
    spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = QUERIES["compress_roundtrip"](spark, str(tmp_path))

    @F.pandas_udf("long")
    def size(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    assert rows.count() == 64
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 8
