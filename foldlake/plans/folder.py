"""Queries over one folder: state, listings, snapshots, storage, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlake.operators import bloom, merkle, reach, snapshots, state
from foldlake.plans.relations import MERKLE, query
from foldlake.session import settled
from foldlake.sources import tables as t

CUTOFF_MS, QUOTA, NOW_MS, SAFE_SEQ = 1900, 3_000_000, 1_715_000_000_000, 9_500
KEYS = "path, manifest_id, c, seq, author, authored_ms, deleted"
HEADERS = f"""leaf AS (SELECT snap_seq AS g, path, manifest_id, deleted FROM snapshot_manifests UNION ALL SELECT 5, path, manifest_id, deleted FROM manifests), {MERKLE},
roots AS (SELECT g AS snap_seq, h AS root_hash, (SELECT count(*) FROM leaf l WHERE l.g = tree.g) AS manifest_n FROM tree WHERE n = 1),
snapshots AS (SELECT snap_seq, root_hash, CASE WHEN snap_seq > 1 THEN snap_seq - 1 END AS parent_seq, manifest_n FROM roots WHERE snap_seq < 5)"""


@query(f"SELECT {KEYS} FROM manifests")
def state_latest(spark, d):
    return t.manifests(spark, d)


@query("SELECT path, manifest_id, seq, deleted FROM feed WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def state_asof(spark, d):
    return state.as_of(t.feed(spark, d).select("path", "manifest_id", "seq", "deleted"), seq=5000)


@query("SELECT seq, path, manifest_id, deleted FROM feed WHERE seq > 900")
def feed_since(spark, d):
    return state.since(t.feed(spark, d).select("seq", "path", "manifest_id", "deleted"), 900)


@query("SELECT path, manifest_id, seq FROM manifests WHERE NOT deleted ORDER BY path")
def live_manifests(spark, d):
    return state.live(t.manifests(spark, d)).select("path", "manifest_id", "seq").orderBy("path")


@query("SELECT coalesce(max(seq), 0) AS high_water, count(*) AS paths, count(*) FILTER (NOT deleted) AS live_paths FROM manifests")
def folder_summary(spark, d):
    return state.summary(t.manifests(spark, d))


@query("""SELECT path, reason FROM (
  SELECT f.path, CASE WHEN k.path IS NULL THEN 'new' WHEN k.deleted THEN 'restored' WHEN f.kind <> k.kind OR f.mode <> k.mode OR f.mtime_ns <> k.mtime_ns OR f.size <> k.size OR f.inode <> k.inode THEN 'changed' END AS reason
  FROM files f LEFT JOIN known_files k USING (path)) WHERE reason IS NOT NULL""")
def stat_changed(spark, d):
    return state.stat_changed(t.files(spark, d), t.known_files(spark, d))


@query("SELECT path FROM known_files WHERE NOT deleted AND path NOT IN (SELECT path FROM files)")
def deleted_files(spark, d):
    return state.missing_files(t.known_files(spark, d), t.files(spark, d))


@query("""SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
  b.manifest_id AS before_id, a.manifest_id AS after_id, b.deleted AS before_deleted, a.deleted AS after_deleted
FROM (SELECT * FROM snapshot_manifests WHERE snap_seq = 1) b FULL JOIN (SELECT * FROM snapshot_manifests WHERE snap_seq = 4) a USING (path)
WHERE b.path IS NULL OR a.path IS NULL OR b.manifest_id <> a.manifest_id OR b.deleted <> a.deleted""")
def snapshot_diff(spark, d):
    leaves = t.snapshot_manifests(spark, d)
    return state.diff(leaves.where("snap_seq = 1"), leaves.where("snap_seq = 4"))


@query("SELECT * FROM (SELECT path, manifest_id FROM snapshot_manifests WHERE snap_seq = 2 AND NOT deleted INTERSECT SELECT path, manifest_id FROM snapshot_manifests WHERE snap_seq = 3 AND NOT deleted)")
def snapshot_unchanged(spark, d):
    live = state.live(t.snapshot_manifests(spark, d))
    side = lambda n: live.where(F.col("snap_seq") == n).select("path", "manifest_id")
    return side(2).intersect(side(3))


@query("""SELECT g.content, from_path, to_path FROM
  (SELECT b.content, b.path AS from_path, row_number() OVER (PARTITION BY b.content ORDER BY b.path) AS n FROM before_ b ANTI JOIN after_ USING (path)) g
  JOIN (SELECT a.content, a.path AS to_path, row_number() OVER (PARTITION BY a.content ORDER BY a.path) AS n FROM after_ a ANTI JOIN before_ USING (path)) c USING (content, n)""",
"""before_ AS (SELECT path, split_part(path, '/', 2) || ':' || seq % 3 AS content FROM feed WHERE CAST(substr(split_part(path, '/', 1), 2) AS INT) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
after_ AS (SELECT path, split_part(path, '/', 2) || ':' || seq % 3 AS content FROM feed WHERE CAST(substr(split_part(path, '/', 1), 2) AS INT) % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)""")  # fmt: skip
def rename_pairs(spark, d):
    f = t.feed(spark, d).select("path", "seq")
    content = F.concat(F.split_part("path", F.lit("/"), F.lit(2)), F.lit(":"), F.col("seq") % 3)
    side = lambda part: state.latest(part).select("path", content.alias("content"))
    user = F.regexp_extract("path", r"^u(\d+)/", 1).cast("int")
    return state.rename_pairs(side(f.where(user % 3 != 0)), side(f.where(user % 4 != 0)))


@query("""SELECT path, manifest_id, CASE WHEN fresh THEN 1000000 - 1 + row_number() OVER (PARTITION BY fresh ORDER BY path) ELSE seq END AS seq, CASE WHEN fresh THEN false ELSE deleted END AS deleted,
  CASE WHEN fresh THEN 'written' ELSE 'kept' END AS action FROM (
  SELECT path, coalesce(n.manifest_id, o.manifest_id) AS manifest_id, o.seq, o.deleted,
    n.manifest_id IS NOT NULL AND (o.manifest_id IS NULL OR o.deleted OR o.manifest_id <> n.manifest_id) AS fresh
  FROM (SELECT path, manifest_id, seq, deleted FROM feed WHERE seq <= 700 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) o
  FULL JOIN (SELECT path, manifest_id FROM manifests WHERE NOT deleted) n USING (path))""")
def manifest_upsert(spark, d):
    old = state.as_of(t.feed(spark, d).select("path", "manifest_id", "seq", "deleted"), seq=700)
    return state.upsert(old, state.live(t.manifests(spark, d)).select("path", "manifest_id"), 1_000_000)


@query("""SELECT path, m.manifest_id, seq, deleted OR gone AS deleted, CASE WHEN gone AND NOT deleted THEN 1700000000000 + 7776000000 END AS expires_ms
FROM (SELECT *, seq % 3 = 0 AS gone FROM manifests) m""")
def tombstone_put(spark, d):
    m = t.manifests(spark, d).select("path", "manifest_id", "seq", "deleted")
    return state.tombstone(m, m.where("seq % 3 = 0").select("path"), 1_700_000_000_000)


@query("SELECT DISTINCT path || CASE WHEN seq % 5 = 0 THEN '~' ELSE '' END AS path FROM manifests WHERE seq % 5 = 0")
def tombstone_unknown(spark, d):
    """Paths to delete that the model does not have: a strict deletion fails on them."""
    m = t.manifests(spark, d).select("path", "seq")
    return state.unknown_paths(m, m.select(F.when(F.col("seq") % 5 == 0, F.concat("path", F.lit("~"))).otherwise(F.col("path")).alias("path")))


@query("SELECT path, kind, mode, mtime_ns, size, inode, deleted FROM known_files WHERE path = (SELECT min(path) FROM known_files)")
def stat_lookup(spark, d):
    known = t.known_files(spark, d)
    return state.stat(known, known.agg(F.min("path")).first()[0])


@query("""SELECT path, seq, deleted FROM manifests WHERE NOT (deleted AND authored_ms + 7776000000 <= 1715000000000
  AND seq <= (SELECT CASE WHEN bool_or(epoch IS NULL OR epoch <> 1) THEN 0 ELSE min(high_water) END FROM (SELECT 'p' || p AS peer_id FROM range(4, 19) x(p)) LEFT JOIN receipts USING (peer_id)))""")
def tombstone_sweep_gated(spark, d):
    """The hourly sweep: up to the sequence that every member has confirmed."""
    from foldlake.operators import members

    peers = spark.range(4, 19).select(F.concat(F.lit("p"), "id").alias("peer_id"))
    safe = members.converged_high_water(peers, t.receipts(spark, d), 1).first()["high_water"]
    m = t.manifests(spark, d).select("path", "seq", "deleted", (F.col("authored_ms") + state.TOMBSTONE_DAYS * 86_400_000).alias("expires_ms"))
    return state.sweep_tombstones(m, NOW_MS, safe).drop("expires_ms")


@query("SELECT path, manifest_id, seq % 13 <> 0 AS intact FROM manifests")
def manifest_verify(spark, d):
    """Rows read back with their identity worked out again; every thirteenth has other content."""
    m = t.manifests(spark, d).select("path", "manifest_id", "c", "seq")
    own = F.sha2(F.concat("path", F.lit(":"), F.when(F.col("seq") % 13 == 0, -1).otherwise(F.col("c"))).cast("binary"), 256)
    return state.verified(m, m.select("path", own.alias("computed_id")))


@query(f"SELECT path, seq, deleted FROM manifests WHERE NOT (deleted AND authored_ms + 7776000000 <= {NOW_MS} AND seq <= {SAFE_SEQ})")
def tombstone_sweep(spark, d):
    m = t.manifests(spark, d).select("path", "seq", "deleted", (F.col("authored_ms") + state.TOMBSTONE_DAYS * 86_400_000).alias("expires_ms"))
    return state.sweep_tombstones(m, NOW_MS, SAFE_SEQ).drop("expires_ms")


@query("SELECT chunk_id FROM chunks WHERE chunk_id > '4' ORDER BY chunk_id LIMIT 50")
def keyset_page(spark, d):
    return state.keyset_page(t.chunks(spark, d).select("chunk_id"), "chunk_id", "4", 50)


@query("SELECT path, (row_number() OVER (ORDER BY path) - 1) // 64 AS batch FROM manifests")
def fixed_batches(spark, d):
    return state.batches(t.manifests(spark, d).select("path"), ["path"], 64)


@query("SELECT manifest_id, ord, chunk_id, length, CAST(coalesce(sum(length) OVER (PARTITION BY manifest_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM manifest_chunks")
def chunk_offsets(spark, d):
    return state.offsets(t.manifest_chunks(spark, d))


@query("SELECT path, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS rest FROM (SELECT path, list(c ORDER BY seq) AS a, [1, 4, 9] AS b FROM feed GROUP BY path)")
def set_minus(spark, d):
    own = t.feed(spark, d).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda x: x["c"]).alias("a"))
    return own.select("path", F.array_join(state.set_minus(F.col("a"), F.array(*map(F.lit, (1, 4, 9)))), ",").alias("rest"))


@query("SELECT snap_seq, root_hash, parent_seq, manifest_n FROM snapshots", HEADERS)
def snapshot_roots(spark, d):
    return t.snapshots(spark, d)


@query("SELECT s.snap_seq, s.root_hash, s.parent_seq, p.root_hash AS parent_root, s.manifest_n FROM snapshots s LEFT JOIN snapshots p ON p.snap_seq = s.parent_seq", HEADERS)
def snapshot_parent(spark, d):
    return snapshots.with_parent(t.snapshots(spark, d))


@query("SELECT snap_seq, root_hash, root_hash IS DISTINCT FROM lag(root_hash) OVER (ORDER BY snap_seq) AS written FROM (SELECT snap_seq, root_hash FROM snapshots UNION ALL SELECT 5, root_hash FROM snapshots WHERE snap_seq = 4)", HEADERS)
def snapshot_cut_dedup(spark, d):
    s = t.snapshots(spark, d)
    again = s.where("snap_seq = 4").withColumn("snap_seq", F.lit(5).cast("bigint"))
    return snapshots.cuts(s.union(again))


@query("SELECT snap_seq, path, manifest_id FROM snapshot_manifests WHERE snap_seq NOT IN (SELECT snap_seq FROM snapshots WHERE root_hash = (SELECT root_hash FROM snapshots WHERE snap_seq = 2))", HEADERS)
def snapshot_forget(spark, d):
    heads, leaves = settled(t.snapshots(spark, d)), t.snapshot_manifests(spark, d)
    return snapshots.forget(heads, leaves, _root(heads, 2))[1].select("snap_seq", "path", "manifest_id")


def _root(heads, seq):
    """The root that a caller names: one value of a header."""
    return heads.where(F.col("snap_seq") == seq).first()["root_hash"]


@query("SELECT snap_seq, root_hash, parent_seq, manifest_n FROM snapshots WHERE root_hash = (SELECT root_hash FROM snapshots WHERE snap_seq = 3) ORDER BY snap_seq DESC LIMIT 1", HEADERS)
def snapshot_by_root(spark, d):
    heads = settled(t.snapshots(spark, d))
    return snapshots.by_root(heads, _root(heads, 3))


@query("SELECT s.snap_seq, s.root_hash, p.root_hash AS parent_root, l.path, l.manifest_id, l.deleted FROM snapshots s LEFT JOIN snapshots p ON p.snap_seq = s.parent_seq JOIN snapshot_manifests l ON l.snap_seq = s.snap_seq WHERE s.snap_seq = 3", HEADERS)
def snapshot_get(spark, d):
    heads = settled(t.snapshots(spark, d))
    return snapshots.get(heads, t.snapshot_manifests(spark, d), _root(heads, 3))


@query("""SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
  b.manifest_id AS before_id, a.manifest_id AS after_id, b.deleted AS before_deleted, a.deleted AS after_deleted
FROM (SELECT * FROM snapshot_manifests WHERE snap_seq = 2) b FULL JOIN (SELECT * FROM snapshot_manifests WHERE snap_seq = 3) a USING (path)
WHERE b.path IS NULL OR a.path IS NULL OR b.manifest_id <> a.manifest_id OR b.deleted <> a.deleted""")
def snapshot_diff_roots(spark, d):
    """The same by roots; a root that no snapshot has is an error."""
    heads = settled(t.snapshots(spark, d))
    return snapshots.diff_roots(heads, merkle.planted(t.snapshot_manifests(spark, d), "snap_seq"), _root(heads, 2), _root(heads, 3))


CUT = """new_ AS (SELECT 5 AS snap_seq, root_hash, 4 AS parent_seq, manifest_n FROM roots WHERE snap_seq = 5 AND root_hash <> (SELECT root_hash FROM snapshots WHERE snap_seq = 4))"""


@query("SELECT snap_seq, root_hash, parent_seq, manifest_n FROM snapshots UNION ALL SELECT snap_seq, root_hash, parent_seq, manifest_n FROM new_", HEADERS + ", " + CUT)
def snapshot_cut(spark, d):
    """Headers after two cuts of the current rows: the second finds its root there already."""
    now = t.manifests(spark, d).select("path", "manifest_id", "deleted")
    one = [settled(x) for x in snapshots.cut(t.snapshots(spark, d), t.snapshot_manifests(spark, d), now)]
    return snapshots.cut(*one, now)[0]


@query("SELECT snap_seq, root_hash, parent_seq, manifest_n FROM snapshots", HEADERS)
def snapshot_cut_changes(spark, d):
    """The four cuts by what changed since the one before: the first tree is planted, the others grow."""
    leaves = t.snapshot_manifests(spark, d)
    one = leaves.where("snap_seq = 1")
    heads, tree = settled(snapshots.headers(one)), merkle.planted(one)
    for n in (2, 3, 4):
        old, new = (leaves.where(F.col("snap_seq") == k).select("path", "manifest_id", "deleted") for k in (n - 1, n))
        heads, tree = snapshots.cut_changes(heads, tree, new.exceptAll(old))
        heads = settled(heads)
    return heads


@query("SELECT snap_seq, path, manifest_id, deleted FROM snapshot_manifests UNION ALL SELECT snap_seq, path, manifest_id, deleted FROM manifests, new_", HEADERS + ", " + CUT)
def snapshot_cut_leaves(spark, d):
    now = t.manifests(spark, d).select("path", "manifest_id", "deleted")
    return snapshots.cut(t.snapshots(spark, d), t.snapshot_manifests(spark, d), now)[1]

@query("SELECT chunk_id FROM reachable")
def reachable_chunks(spark, d):
    return reach.reachable_chunks(t.manifests(spark, d), t.snapshot_manifests(spark, d), t.manifest_chunks(spark, d))


BYTES = "SELECT CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes, count(*) AS chunks FROM (SELECT chunk_id, any_value(length) AS length FROM manifest_chunks WHERE manifest_id IN ({}) GROUP BY chunk_id)"


@query(BYTES.format("SELECT manifest_id FROM live"))
def logical_bytes_live(spark, d):
    return reach.logical_bytes(state.live(t.manifests(spark, d)), t.manifest_chunks(spark, d))


@query(BYTES.format("SELECT manifest_id FROM live UNION SELECT manifest_id FROM leaves"))
def logical_bytes_reachable(spark, d):
    return reach.logical_bytes(reach.reachable_manifests(t.manifests(spark, d), t.snapshot_manifests(spark, d)), t.manifest_chunks(spark, d))


@query("SELECT DISTINCT chunk_id FROM manifest_chunks WHERE manifest_id IN (SELECT manifest_id FROM leaves) AND chunk_id NOT IN (SELECT chunk_id FROM manifest_chunks WHERE manifest_id IN (SELECT manifest_id FROM live))")
def superseded_history(spark, d):
    return reach.superseded(t.manifests(spark, d), t.snapshot_manifests(spark, d), t.manifest_chunks(spark, d))


@query("""SELECT a.snap_seq, CAST(a.bytes AS BIGINT) AS bytes, CAST(coalesce(b.new_bytes, 0) AS BIGINT) AS new_bytes
FROM (SELECT snap_seq, sum(length) AS bytes FROM each_ GROUP BY snap_seq) a
LEFT JOIN (SELECT snap_seq, sum(length) AS new_bytes FROM (SELECT chunk_id, min(snap_seq) AS snap_seq, any_value(length) AS length FROM each_ GROUP BY chunk_id) GROUP BY snap_seq) b USING (snap_seq)""",
"each_ AS (SELECT DISTINCT snap_seq, chunk_id, length FROM snapshot_manifests JOIN manifest_chunks USING (manifest_id) WHERE NOT deleted)")
def structural_sharing(spark, d):
    return reach.sharing(t.snapshot_manifests(spark, d), t.manifest_chunks(spark, d))


@query(f"SELECT chunk_id, plaintext_length, last_seen_ms, blob_id FROM chunks WHERE last_seen_ms < {CUTOFF_MS} AND chunk_id NOT IN (SELECT chunk_id FROM reachable)")
def gc_victims(spark, d):
    reached = reachable_chunks(spark, d)
    return reach.victims(t.chunks(spark, d), reached, CUTOFF_MS)


@query(f"SELECT chunk_id, blob_id FROM chunks WHERE NOT (last_seen_ms < {CUTOFF_MS} AND chunk_id NOT IN (SELECT chunk_id FROM reachable))")
def gc_sweep(spark, d):
    return reach.sweep(t.chunks(spark, d), reachable_chunks(spark, d), CUTOFF_MS).select("chunk_id", "blob_id")


@query("SELECT blob_id FROM (SELECT DISTINCT blob_id FROM chunks) WHERE blob_id NOT IN (SELECT blob_id FROM chunks WHERE last_seen_ms >= 2900)")
def dead_blobs(spark, d):
    c = t.chunks(spark, d)
    return reach.dead_containers(c.select("blob_id").distinct(), c.where("last_seen_ms >= 2900"))


@query("SELECT DISTINCT chunk_id FROM manifest_chunks WHERE manifest_id IN (SELECT manifest_id FROM live) AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE blob_id < 12)")
def missing_chunks(spark, d):
    wanted = t.manifest_chunks(spark, d).join(state.live(t.manifests(spark, d)), "manifest_id", "left_semi")
    return reach.missing_chunks(wanted, t.chunks(spark, d).where("blob_id < 12"))


@query("SELECT DISTINCT chunk_id FROM manifest_chunks WHERE manifest_id IN (SELECT manifest_id FROM live) AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE blob_id < 12)")
def missing_chunks_bloom(spark, d):
    """The same by a Bloom filter of the chunk index, which was built in two parts."""
    wanted = t.manifest_chunks(spark, d).join(state.live(t.manifests(spark, d)), "manifest_id", "left_semi")
    index = settled(t.chunks(spark, d).where("blob_id < 12").select("chunk_id", "blob_id"))
    blocks = bloom.blocks_for(index.count())
    parts = [bloom.built(index.where(rule), "chunk_id", blocks) for rule in ("blob_id < 6", "blob_id >= 6")]
    return bloom.missing(wanted, index, "chunk_id", settled(bloom.merged(*parts)), blocks)


@query("SELECT chunk_id, max(length + 1000 * ord) AS last_seen_ms, any_value(length) AS length FROM manifest_chunks GROUP BY chunk_id")
def chunk_dedup_upsert(spark, d):
    return t.manifest_chunks(spark, d).groupBy("chunk_id").agg(F.max(F.col("length") + 1000 * F.col("ord")).alias("last_seen_ms"), F.any_value("length").alias("length"))


@query("""SELECT DISTINCT chunk_id FROM (
  SELECT path, chunk_id FROM (SELECT path, manifest_id, deleted FROM feed WHERE seq <= 600 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) JOIN manifest_chunks USING (manifest_id) WHERE NOT deleted
  EXCEPT SELECT path, chunk_id FROM manifests JOIN manifest_chunks USING (manifest_id) WHERE NOT deleted)""")
def superseded_by_batch(spark, d):
    chunks, f = t.manifest_chunks(spark, d), t.feed(spark, d)
    held = lambda m: state.live(m).join(chunks, "manifest_id").select("path", "chunk_id")
    return reach.superseded_by_batch(held(state.as_of(f, seq=600)), held(t.manifests(spark, d)))


@query("SELECT blob_id AS id, mod_ms FROM (SELECT blob_id, max(last_seen_ms) AS mod_ms FROM chunks GROUP BY blob_id) WHERE mod_ms < 4200 AND blob_id NOT IN (SELECT blob_id FROM chunks WHERE plaintext_length > 1250)")
def holder_gc(spark, d):
    c = t.chunks(spark, d)
    blobs = c.groupBy(F.col("blob_id").alias("id")).agg(F.max("last_seen_ms").alias("mod_ms"))
    return reach.held_by_nobody(blobs, c.where("plaintext_length > 1250").select(F.col("blob_id").alias("id")), 4200)


@query(f"""SELECT CAST(coalesce(f.forgotten, l.forgotten) AS BIGINT) AS forgotten, CAST(coalesce(f.used, l.used) AS BIGINT) AS used, f.forgotten IS NOT NULL AS fits
FROM (SELECT * FROM usage_ ORDER BY forgotten DESC LIMIT 1) l LEFT JOIN (SELECT * FROM usage_ WHERE used <= {QUOTA} ORDER BY forgotten LIMIT 1) f ON true""",
f"""{HEADERS}, death AS (SELECT snap_seq, min(snap_seq) OVER (PARTITION BY root_hash) AS death FROM snapshots),
dying AS (SELECT chunk_id, max(death) AS death, any_value(length) AS length FROM manifest_chunks JOIN (
  SELECT manifest_id, death FROM snapshot_manifests JOIN death USING (snap_seq) WHERE NOT deleted UNION ALL SELECT manifest_id, 99 FROM live) USING (manifest_id) GROUP BY chunk_id),
usage_ AS (SELECT n AS forgotten, coalesce((SELECT sum(length) FROM dying WHERE death > n), 0) AS used FROM (VALUES (0), (1), (2), (3), (4)) k(n))""")  # fmt: skip
def quota_prune(spark, d):
    return reach.prune_to_fit(reach.usage_after_forgetting(t.manifests(spark, d), t.snapshots(spark, d), t.snapshot_manifests(spark, d), t.manifest_chunks(spark, d)), QUOTA)
