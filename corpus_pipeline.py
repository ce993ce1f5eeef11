"""A training-corpus pipeline over ``documents``: quality rules, exact dedup, near-dedup, mixing, tokens.

Every stage takes all rows its predecessor kept; all but the last return the columns of ``documents``.  A document that
the mix takes twice is there twice.

Defined cases: stages decide by row and never by id, so ids may be null or repeated: quality judges each row, exact dedup and
near-dedup keep one row of a group (the smallest id, nulls last; of equal rows one), the mix copies a row as often as
it chose that row.  Null and empty texts fail the quality rules.  A null source is a source of its own.  Ties go by the
row's hash.  An empty table gives no rows.  Columns beyond ``text``, ``source`` and ``doc_id`` pass through whatever their names, but
for names that begin with ``_foldlake_``; ``n_chars`` is counted again where lines were cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm import bpe, exact, mixing, neardup, quality
from foldlake.llm.common import ROW, read_table, row_key, rows_of, shared_dir
from foldlake.llm.queries import MIX_RATIO, MIX_WEIGHTS, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(row_key(docs).alias(ROW), "doc_id", "text")
    groups = neardup.link(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = groups.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", ROW))[ROW].alias(ROW))
    return rows_of(docs, first.select(ROW))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn(ROW, row_key(docs))
    # equal rows share a key: one of them is copied as often as they were chosen together
    chosen = mixing.mix(keyed, MIX_WEIGHTS, MIX_RATIO, epochs=2, key_col=ROW).where("chosen").groupBy(ROW).agg(F.count("*").alias("_foldlake_times"))
    return rows_of(docs, chosen).withColumn("_foldlake_copy", F.explode(F.sequence(F.lit(1), F.col("_foldlake_times").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("exact", exact_dedup),
    ("near", near_dedup),
    ("mix", mix_sources),
    ("bpe", tokens),
]

#: Tries, sketches and tokens are beyond SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
