"""Queries over files: a tree written from ``documents`` by the sink, listed and watched by the source; the blob store."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.plans.relations import query
from foldlake.session import release, settled, shared_dir
from foldlake.sources import tables as t
from foldlake.sources import trees
from foldlake.sources.files import BlobStore


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/foldlake-{uuid.uuid4().hex}"


def _done(root: str, out: DataFrame) -> DataFrame:
    """The rows, settled, after which the folder that they were read from can go."""
    out = settled(out)
    trees.remove(out.sparkSession, root)
    return out


def _entries(spark, d) -> DataFrame:
    """Documents as rows of a tree: files of two modes, links and empty folders."""
    k = F.col("doc_id")
    kind = F.when(k % 7 == 3, "symlink").when(k % 11 == 5, "dir").otherwise("regular")
    docs = t.table(spark, d, "documents").withColumn("kind", kind)
    return docs.select(
        "doc_id", F.concat("source", F.lit("/d"), k).alias("path"), "kind", F.when(kind == "regular", F.coalesce("text", F.lit("")).cast("binary")).alias("content"),
        F.when(kind == "regular", F.when(k % 5 == 0, 0o755).otherwise(0o644)).alias("mode"), F.when(kind == "symlink", F.concat(F.lit("../src"), k % 3, F.lit("/d"), k + 1)).alias("target"),
    )


TREE = """entries AS (SELECT doc_id, source, text, source || '/d' || doc_id AS path, CASE WHEN doc_id % 7 = 3 THEN 'symlink' WHEN doc_id % 11 = 5 THEN 'dir' ELSE 'regular' END AS kind FROM documents)"""


@query("""SELECT path, kind, CASE WHEN kind = 'regular' THEN CASE WHEN doc_id % 5 = 0 THEN 493 ELSE 420 END END AS mode, CASE WHEN kind = 'regular' THEN strlen(coalesce(text, '')) ELSE 0 END AS size,
  CASE WHEN kind = 'symlink' THEN '../src' || doc_id % 3 || '/d' || (doc_id + 1) END AS target FROM entries UNION ALL SELECT DISTINCT source, 'dir', NULL, 0, NULL FROM entries""", TREE)  # fmt: skip
def tree_listing(spark, d):
    """What the source lists of a tree that the sink has written."""
    root = _made(spark)
    trees.materialise(_entries(spark, d).drop("doc_id"), root)
    return _done(root, trees.listing(spark, root).select("path", "kind", F.when(F.col("kind") == "regular", F.col("mode")).alias("mode"), "size", "target"))


def _made(spark) -> str:
    import os

    root = _folder(spark)
    os.makedirs(trees.local(root))
    return root


@query("SELECT source, count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, bool_and(kind <> 'symlink') AS whole FROM entries WHERE kind = 'regular' GROUP BY source", TREE)
def tree_contents(spark, d):
    """Contents as read back from the files, by their top folder; each is compared with its document."""
    root = _made(spark)
    trees.materialise(_entries(spark, d).drop("doc_id"), root)
    read = trees.listing(spark, root, content=True).where("kind = 'regular'").select("path", "content")
    both = read.join(_entries(spark, d).select("path", F.sha2("content", 256).alias("sha")), "path", "left")
    same = F.bool_and(F.coalesce(F.sha2("content", 256) == F.col("sha"), F.lit(False)))
    return _done(root, both.groupBy(F.substring_index("path", "/", 1).alias("source")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"), same.alias("whole")))


@query("""SELECT source || '/d' || doc_id AS path, CASE doc_id % 9 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 16 ELSE 1 END AS op FROM documents WHERE doc_id % 9 BETWEEN 1 AND 4
UNION ALL SELECT source, 1 FROM documents GROUP BY source HAVING bool_and(doc_id % 9 = 4)""")
def tree_events(spark, d):
    """Events of a tree between two looks at it: documents by ``doc_id % 9`` are removed (1), written (2), given a mode (3) or created (4)."""
    root, state, seen = _made(spark), _folder(spark), _folder(spark)
    k = F.col("doc_id") % 9
    docs = t.table(spark, d, "documents").select(k.alias("k"), F.concat("source", F.lit("/d"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def step(batch: DataFrame, n: int) -> None:
        batch = settled(batch)  # read once for both sides of the join
        trees.with_renames(batch).write.mode("overwrite").parquet(f"{seen}/v{n}")
        release(batch)

    def look() -> None:
        stream = trees.changes(spark, root, state)
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{seen}-checkpoint").trigger(availableNow=True).start().awaitTermination()

    trees.materialise(docs.where("k <> 4").select("path", "content", F.lit(0o644).alias("mode")), root)
    look()
    content = F.when(F.col("k") == 2, F.concat("content", F.lit("!").cast("binary"))).when(F.col("k") == 4, F.col("content"))
    trees.materialise(docs.where("k BETWEEN 1 AND 4").select("path", content.alias("content"), F.when(F.col("k") == 3, 0o600).otherwise(0o644).alias("mode"), (F.col("k") == 1).alias("deleted")), root)
    look()
    out = _done(root, spark.read.parquet(f"{seen}/v1").select("path", "op"))
    for x in (state, seen, f"{seen}-checkpoint"):
        shutil.rmtree(trees.local(x))
    return out


@query("SELECT path FROM known_files k WHERE NOT deleted AND path NOT IN (SELECT path FROM files) AND split_part(path, '/', 1) NOT IN ('src3', 'src11')")
def tree_vanished(spark, d):
    """Known files that a listing lacks; two folders could not be read."""
    listed = t.files(spark, d).select("path", F.lit(None).cast("string").alias("error"))
    shut = spark.range(1).select(F.explode(F.array(F.lit("src3"), F.lit("src11"))).alias("path"), F.lit("permission denied").alias("error"))
    return trees.vanished(t.known_files(spark, d).where("NOT deleted").select("path"), listed.unionByName(shut))


def _store(spark, d) -> BlobStore:
    """Chunks put twice, in part, deleted in part, and put again in part."""
    store, c = BlobStore(spark, _folder(spark)), t.chunks(spark, d)
    blobs = lambda rule, ms: c.where(rule).select(F.col("chunk_id").alias("id"), F.concat("chunk_id", F.lit(":"), "plaintext_length").cast("binary").alias("data"), F.lit(ms).cast("long").alias("mod_ms"))
    store.put(blobs("blob_id < 14", 1))
    store.put(blobs("blob_id BETWEEN 5 AND 15", 2))
    store.delete(blobs("blob_id IN (2, 6, 18)", 0).select("id"))
    store.put(blobs("blob_id = 6 AND plaintext_length > 300", 3))
    return store


STORE = """store AS (SELECT chunk_id AS id, blob_id, CASE WHEN blob_id = 6 THEN 3 WHEN blob_id >= 5 THEN 2 ELSE 1 END::BIGINT AS mod_ms, sha256(chunk_id || ':' || plaintext_length) AS digest
  FROM chunks WHERE blob_id < 16 AND blob_id <> 2 AND (blob_id <> 6 OR plaintext_length > 300))"""


@query("SELECT id, digest, mod_ms FROM store WHERE blob_id % 2 = 0", STORE)
def blob_get(spark, d):
    ids = t.chunks(spark, d).where("blob_id % 2 = 0").select(F.col("chunk_id").alias("id"))
    return _store(spark, d).get(ids).select("id", F.sha2("data", 256).alias("digest"), "mod_ms")


@query("SELECT chunk_id AS id FROM chunks WHERE chunk_id NOT IN (SELECT id FROM store)", STORE)
def blob_missing(spark, d):
    return _store(spark, d).missing(t.chunks(spark, d).select(F.col("chunk_id").alias("id")))


@query("SELECT id, mod_ms FROM store WHERE id > '8' ORDER BY id LIMIT 100", STORE)
def blob_page(spark, d):
    """A page of the store in order of ids, after it was compacted."""
    store = _store(spark, d)
    store.compact()
    return store.page("8", 100)
