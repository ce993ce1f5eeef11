"""Column functions and SQL registration of the byte-level functions."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.functions import chunking, crypto, digest, encoding

RAW, ZSTD = 0, 1


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.BinaryType())
def blake3(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else digest.blake3(bytes(b)))


@F.pandas_udf(T.StructType().add("codec", "integer").add("data", "binary"))
def compress(data: pd.Series) -> pd.DataFrame:
    """zstd if that is smaller, else the bytes as they are."""
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    packed = [(ZSTD, z) if len(z := c.compress(bytes(b))) < len(b) else (RAW, bytes(b)) for b in data]
    return pd.DataFrame(packed, columns=["codec", "data"])


def decompress_one(codec: int, data: bytes, limit: int) -> bytes | None:
    import zstandard

    if codec == RAW:
        return data if len(data) <= limit else None
    if codec != ZSTD:
        return None
    try:
        size = zstandard.frame_content_size(data)
        if size > limit:
            return None
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=limit)
    except zstandard.ZstdError:
        return None


@F.pandas_udf(T.BinaryType())
def decompress(codec: pd.Series, data: pd.Series, limit: pd.Series) -> pd.Series:
    """The bytes; null for an unknown codec, damage, or more than ``limit`` bytes."""
    return pd.Series([decompress_one(c, bytes(d), n) for c, d, n in zip(codec, data, limit)])


@F.pandas_udf(T.BinaryType())
def identity(kind: pd.Series, path: pd.Series, mode: pd.Series, target: pd.Series, chunks: pd.Series) -> pd.Series:
    """Canonical identity bytes; ``chunks`` is an array of (id, length) in order.  Hash them with ``sha2`` or ``blake3``."""
    rows = zip(kind, path, mode, target, chunks)
    return pd.Series([encoding.identity_bytes(int(k), p, int(m), t or "", [(bytes(c["id"]), int(c["length"])) for c in cs]) for k, p, m, t, cs in rows])


@F.pandas_udf(T.BinaryType())
def vector_bytes(nodes: pd.Series, counters: pd.Series) -> pd.Series:
    return pd.Series([encoding.encode_vector(dict(zip(map(str, n), map(int, c)))) for n, c in zip(nodes, counters)])


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def vector_parse(data: pd.Series) -> pd.Series:
    """The version vector of canonical bytes; null where they are cut off, have bytes left over, or are not canonical."""

    def one(b):
        try:
            vector = encoding.decode_vector(bytes(b))
        except (ValueError, UnicodeDecodeError):
            return None
        return vector if encoding.encode_vector(vector) == bytes(b) else None

    return data.map(one)


@F.pandas_udf(T.BinaryType())
def blind_id(key: pd.Series, chunk_id: pd.Series) -> pd.Series:
    return pd.Series([crypto.blind_id(bytes(k), bytes(c)) for k, c in zip(key, chunk_id)])


@F.pandas_udf(T.BinaryType())
def verifier(key: pd.Series) -> pd.Series:
    """What two sides compare to know that they hold the same folder key."""
    return key.map(lambda k: crypto.verifier(bytes(k)))


@F.pandas_udf(T.BinaryType())
def passphrase_key(passphrase: pd.Series, salt: pd.Series) -> pd.Series:
    return pd.Series([crypto.passphrase_key(p, bytes(s)) for p, s in zip(passphrase, salt)])


@F.pandas_udf(T.StringType())
def recovery_code(secret: pd.Series) -> pd.Series:
    return secret.map(lambda b: encoding.recovery_code(bytes(b)))


@F.pandas_udf(T.BinaryType())
def read_recovery_code(code: pd.Series) -> pd.Series:
    """The 32-byte key of a recovery code; null for any other text."""

    def one(c):
        try:
            return encoding.read_recovery_code(c, 32)
        except ValueError:
            return None

    return code.map(one)


@F.pandas_udf(T.StringType())
def base32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: encoding.base32_id(bytes(b)))


@F.pandas_udf(T.StringType())
def clean_path(paths: pd.Series) -> pd.Series:
    """Lexically cleaned link target: ``..`` inside is resolved, one that leaves the root stays in front."""
    import posixpath

    return paths.map(lambda p: None if p is None else posixpath.normpath(p) if p else ".")


def chunked(rows: DataFrame, key: str, body: str, params: chunking.Params = chunking.TEXT, with_bytes: bool = False) -> DataFrame:
    """Chunks of every row's bytes: ``key, ord, offset, length, chunk_id`` (SHA-256 hex) and, if wanted, ``bytes``.

    A chunk needs its own stream only, so there is no shuffle; rows are taken a few at a time.
    """
    source = rows.select(F.col(key), F.col(body).cast("binary").alias("_body"))
    schema = f"{key} {source.schema[0].dataType.simpleString()}, ord long, offset long, length long, chunk_id string" + ", bytes binary" * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                out: list[tuple] = []
                for k, b in zip(part.column(0).to_pylist(), part.column(1)):
                    data = b.as_py() or b""
                    for i, (at, n) in enumerate(chunking.boundaries(data, params)):
                        piece = data[at : at + n]
                        out.append((k, i, at, n, hashlib.sha256(piece).hexdigest(), piece)[: 5 + with_bytes])
                if out:
                    kinds = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    names = [key, "ord", "offset", "length", "chunk_id", "bytes"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names[: 5 + with_bytes])

    return source.mapInArrow(run, schema)


def reassembled(chunks: DataFrame, key: str) -> DataFrame:
    """Contents from ordered chunks: ``key, bytes``.  A content fits a row, as it did before it was cut."""
    return chunks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bytes"))), lambda x: x["bytes"]).alias("_c")).select(key, F.aggregate("_c", F.lit(b""), lambda t, x: F.concat(t, x)).alias("bytes"))


def catalogs(rows: DataFrame, key: str) -> DataFrame:
    """One catalog per key (``key, catalog``) of rows ``path, manifest_id`` (hex), ``length``; a folder's catalog is one value by its nature."""

    @F.pandas_udf(T.BinaryType())
    def encoded(entries: pd.Series) -> pd.Series:
        return entries.map(lambda x: encoding.encode_catalog([(encoding.REGULAR, e["path"], 0o644, "", [(bytes.fromhex(e["manifest_id"]), int(e["length"]))]) for e in x]))

    return rows.groupBy(key).agg(F.collect_list(F.struct("path", "manifest_id", "length")).alias("_e")).select(key, encoded("_e").alias("catalog"))


def catalog_entries(catalogs: DataFrame, key: str) -> DataFrame:
    """Rows of catalogs (``key, catalog``): ``key, kind, path, mode, target, chunk_id, length``; a damaged catalog fails the job."""
    schema = f"{key} {catalogs.schema[key].dataType.simpleString()}, kind int, path string, mode int, target string, chunk_id string, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, path, mode, target, chunks in encoding.decode_catalog(body):
                    out += [(k, kind, path, mode, target, c.hex(), n) for c, n in chunks] or [(k, kind, path, mode, target, None, None)]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[key, "kind", "path", "mode", "target", "chunk_id", "length"])

    return catalogs.select(key, "catalog").mapInArrow(run, schema)


def imported(rows: DataFrame, key: str, body: str, index: DataFrame, now_ms: int, params: chunking.Params = chunking.TEXT) -> tuple[DataFrame, DataFrame]:
    """Contents cut and put into a chunk index (``chunk_id, length, last_seen_ms``): references and the index after it."""
    refs = chunked(rows, key, body, params)
    put = index.unionByName(refs.select("chunk_id", "length", F.lit(now_ms).cast("bigint").alias("last_seen_ms")))
    return refs, put.groupBy("chunk_id").agg(F.any_value("length").alias("length"), F.max("last_seen_ms").alias("last_seen_ms"))


def stored(data: Column, key: bytes, chunk_id: Column) -> Column:
    """What is stored of a chunk: the smaller of compressed and raw bytes, sealed; a struct of ``codec`` and ``sealed``."""
    z = compress(data)
    return F.struct(z["codec"].alias("codec"), crypto.seal(z["data"], key, chunk_id).alias("sealed"))


def read_verified(codec: Column, sealed: Column, key: bytes, chunk_id: Column, limit: int = 1 << 26) -> Column:
    """The content of a stored chunk: opened, decompressed and hashed again; null where any of it fails."""
    plain = decompress(codec, F.coalesce(crypto.open_(sealed, key, chunk_id), F.lit(b"")), F.lit(limit))
    return F.when(F.unhex(F.sha2(plain, 256)) == chunk_id, plain)


def parse_size(text: Column) -> Column:
    """Bytes of ``12``, ``3KB``, ``1 mb`` ... (steps of 1000); 0 for the empty text, null for anything else or too much."""
    t = F.trim(text)
    digits = F.regexp_extract(t, r"^(\d+)\s*(?:[kKmMgGtT][bB])?$", 1)
    unit = F.lower(F.regexp_extract(t, r"([kKmMgGtT][bB])$", 1))
    factor = F.when(unit == "kb", 10**3).when(unit == "mb", 10**6).when(unit == "gb", 10**9).when(unit == "tb", 10**12).otherwise(1).cast("bigint")
    return F.when(t == "", F.lit(0).cast("bigint")).otherwise(F.try_multiply(digits.try_cast("bigint"), factor))


def format_size(n: Column, largest: str = "TB") -> Column:
    """Size with one decimal in steps of 1000; above ``largest`` no other unit is taken."""
    steps = ((10**3, "KB"), (10**6, "MB"), (10**9, "GB"), (10**12, "TB"))
    out = F.format_string("%dB", n)
    for limit, unit in steps[: [u for _, u in steps].index(largest) + 1]:
        out = F.when(n < limit, out).otherwise(F.format_string(f"%.1f{unit}", n / limit))
    return out


def register(spark: SparkSession) -> None:
    """Make the byte-level functions callable from SQL."""
    for name, f in {"nfc": nfc, "blake3": blake3, "compress_smaller": compress, "decompress_bounded": decompress, "manifest_identity": identity, "vector_bytes": vector_bytes, "vector_parse": vector_parse, "blind_id": blind_id, "verifier": verifier, "passphrase_key": passphrase_key, "recovery_code": recovery_code, "read_recovery_code": read_recovery_code, "base32": base32, "clean_path": clean_path}.items():
        spark.udf.register(name, f)
