"""Queries over a replica that follows a peer's pages."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.operators import state, vectors
from foldlake.plans.peers import MERGE, _changes, _text
from foldlake.plans.relations import ORACLES, query
from foldlake.session import settled, shared_dir
from foldlake.sources import pages, trees
from foldlake.sources import tables as t
from foldlake.streaming.replica import Replica

#: A page takes a version of two chunks; one of three comes in two slices.
BUDGET, ROW, REF = 200, 96, 40
BATCH = 700


def side(spark, d, every: int) -> DataFrame:
    """The latest versions of a peer that has seen a part of the feed, with their vectors."""
    last = state.latest(t.feed(spark, d).where(F.col("seq") % every == 0).select("path", "seq", "manifest_id", "author", "authored_ms", "deleted"))
    return last.join(vectors.from_rows(_changes(spark, d, every), "path"), "path")


def published(spark, d) -> DataFrame:
    lists = t.manifest_chunks(spark, d).groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "length"))).alias("chunks"))
    return side(spark, d, 3).join(lists, "manifest_id", "left")


def _followed(spark, d, out) -> DataFrame:
    """A replica with rows of its own follows the pages of a peer, stops after the first batch, and goes on to the end."""
    root = f"{shared_dir(spark)}/foldlake-{uuid.uuid4().hex}"
    pages.publish(published(spark, d), f"{root}/peer", 1, BUDGET, ROW, REF)
    replica = Replica(spark, f"{root}/own", "f", "p")
    replica.begin(side(spark, d, 2).select(*replica.read().columns))
    replica.pull(f"{root}/peer", BATCH, once=True)
    Replica(spark, f"{root}/own", "f", "p").pull(f"{root}/peer", BATCH)
    rows = settled(out(replica))
    shutil.rmtree(trees.local(root))
    return rows


OWN = "own AS (SELECT l.path, l.manifest_id, v.vector, l.author, l.authored_ms, l.deleted FROM feed l JOIN (SELECT path, string_agg(node || ':' || counter, ',' ORDER BY node) AS vector FROM a GROUP BY path) v USING (path) WHERE l.seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY l.seq DESC) = 1)"
APPLIED = f"applied AS (SELECT path, manifest_id, vector, author, authored_ms, deleted FROM ({ORACLES['delta_apply'].rsplit(MERGE, 1)[1]}))"


@query("SELECT * FROM applied UNION ALL SELECT * FROM own ANTI JOIN applied USING (path)", f"{MERGE}, {OWN}, {APPLIED}")
def pages_followed(spark, d):
    """Rows of the replica at the end: those of applying the whole delta at once."""
    return _followed(spark, d, lambda r: r.read().withColumn("vector", _text(F.col("vector"))))


@query("""SELECT seq, manifest_id, string_agg(chunk_id || ':' || length, ',' ORDER BY ord) AS chunks FROM (
  SELECT path, seq, manifest_id FROM feed WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) JOIN manifest_chunks USING (manifest_id) GROUP BY seq, manifest_id""")
def pages_received(spark, d):
    """Chunk lists as they came, those in slices put together again."""
    text = F.array_join(F.transform("chunks", lambda c: F.concat(c["chunk_id"], F.lit(":"), c["length"])), ",")
    return _followed(spark, d, lambda r: r.received().select("seq", "manifest_id", text.alias("chunks")))
