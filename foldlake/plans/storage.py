"""Queries over what a node stores: chunk rows, packs, clones, repair, holders, configuration, file kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlake.operators import reach, state, storage
from foldlake.plans.relations import query
from foldlake.sources import files as fs
from foldlake.sources import tables as t

MODES = (0o100644, 0o100755, 0o040755, 0o120777, 0o140600, 0o010600)


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


@query(f"SELECT doc_id, ['regular', 'regular', 'dir', 'symlink'][doc_id % {len(MODES)} + 1] AS kind FROM documents WHERE doc_id % {len(MODES)} < 4")
def file_kinds(spark, d):
    """Kinds by mode bits; sockets and pipes are dropped."""
    docs = t.table(spark, d, "documents").select("doc_id", fs.kind(_pick(MODES, F.col("doc_id") % len(MODES))).alias("kind"))
    return docs.where("kind IS NOT NULL")


@query("""SELECT 'u' || user_id || '/f' || event_id % 7 || '.txt' AS path, bit_or(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END) AS ops FROM events GROUP BY 1""")
def event_ops(spark, d):
    """Events of a path as one mask."""
    is_ = lambda x: F.col("event_type") == x
    e = t.table(spark, d, "events")
    mask = fs.op_mask(is_("signup"), is_("view"), is_("error"), is_("purchase"), is_("click"))
    path = F.concat(F.lit("u"), "user_id", F.lit("/f"), F.col("event_id") % 7, F.lit(".txt"))
    return e.select(path.alias("path"), mask.alias("op")).groupBy("path").agg(F.bit_or("op").alias("ops"))


PATHS = ("a/b.txt", "", "/abs", "a//b", "a/./b", "../x", "ok", "a/..", ".hidden", "a/b/")
KINDS = ("regular", "dir", "symlink", "other")
TARGETS = ("", "b", "/etc", "../up", "x/../../y", "x/../y")
VALIDATED = f"""entries AS (SELECT doc_id AS id, {list(PATHS)}[doc_id % 10 + 1] AS path, {list(KINDS)}[doc_id // 10 % 4 + 1] AS kind, {list(TARGETS)}[doc_id // 3 % 6 + 1] AS target, doc_id // 7 % 3 AS chunks, doc_id // 5 % 4 - 1 AS least FROM documents)"""


def _entries(spark, d):
    k = F.col("doc_id")
    part = lambda n, m: F.floor(k / n) % m
    return t.table(spark, d, "documents").select(k.alias("id"), _pick(PATHS, k % 10).alias("path"), _pick(KINDS, part(10, 4)).alias("kind"), _pick(TARGETS, part(3, 6)).alias("target"), part(7, 3).alias("chunks"), (part(5, 4) - 1).alias("least"))


@query("""SELECT id, CASE WHEN path = '' THEN 'empty path' WHEN path LIKE '/%' THEN 'absolute path' WHEN list_has_any(string_split(path, '/'), ['', '.', '..']) THEN 'bad segment'
  WHEN kind = 'symlink' AND target = '' THEN 'no target' WHEN kind = 'symlink' AND chunks > 0 THEN 'symlink with chunks' WHEN kind = 'symlink' AND target IN ('/etc', '../up', 'x/../../y') THEN 'target escapes'
  WHEN kind = 'dir' AND (chunks > 0 OR target <> '') THEN 'directory with content' WHEN kind = 'regular' AND target <> '' THEN 'file with target' WHEN kind = 'other' THEN 'unknown kind'
  WHEN chunks > 0 AND least <= 0 THEN 'chunk length' ELSE 'ok' END AS state FROM entries""", VALIDATED)  # fmt: skip
def manifest_validate(spark, d):
    state_ = fs.path_state(*map(F.col, ("path", "kind", "target", "chunks", "least")))
    return _entries(spark, d).select("id", state_.alias("state"))


@query("SELECT id, CASE WHEN path <> '' AND path NOT LIKE '/%' AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) THEN '/root/' || path END AS dest FROM entries", VALIDATED)
def destinations(spark, d):
    return _entries(spark, d).select("id", fs.destination(F.lit("/root"), F.col("path")).alias("dest"))


@query("""SELECT manifest_id, ord, chunk_id, length FROM manifest_chunks WHERE ord > 0 UNION ALL
SELECT manifest_id, ord, chunk_id || '+', length FROM manifest_chunks WHERE ord = 0""")
def chunk_rows_insert(spark, d):
    """Insert-or-ignore: rows that are there stay as they are, new ones come in once."""
    rows = t.manifest_chunks(spark, d)
    batch = rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("+")))
    return storage.insert_ignore(rows.where("ord > 0"), batch.unionByName(batch.withColumn("length", F.col("length") + 1)), ["manifest_id", "ord"])


TARGET = 4000
PACKED = f"""streams AS (SELECT chunk_id, substr(chunk_id, 1, 2) AS stream, plaintext_length AS length, row_number() OVER (PARTITION BY substr(chunk_id, 1, 2) ORDER BY chunk_id) AS n FROM chunks),
packed AS (
  SELECT chunk_id, stream, length, n, 0 AS pack, 0::BIGINT AS pack_offset FROM streams WHERE n = 1
  UNION ALL
  SELECT s.chunk_id, s.stream, s.length, s.n, CASE WHEN p.pack_offset + p.length + s.length > {TARGET} THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.pack_offset + p.length + s.length > {TARGET} THEN 0 ELSE p.pack_offset + p.length END
  FROM streams s JOIN packed p ON s.stream = p.stream AND s.n = p.n + 1)"""


def _packed(spark, d):
    c = t.chunks(spark, d).select("chunk_id", F.substring("chunk_id", 1, 2).alias("stream"), F.col("plaintext_length").alias("length"))
    return storage.pack(c, "chunk_id", TARGET)


@query("SELECT chunk_id, stream, pack, pack_offset FROM packed", PACKED)
def pack_files(spark, d):
    return _packed(spark, d).select("chunk_id", "stream", "pack", "pack_offset")


INDEX = """index_ AS (SELECT chunk_id, 'packed' AS backing, blob_id, NULL::BIGINT AS object_id, 0::BIGINT AS "offset", plaintext_length AS length, last_seen_ms FROM chunks WHERE blob_id < 12),
clones AS (SELECT chunk_id, blob_id + 100 AS object_id, last_seen_ms * 2 AS "offset", plaintext_length AS length, 9000 AS seen_ms FROM chunks WHERE blob_id > 8),
cloned AS (SELECT chunk_id, CASE WHEN c.chunk_id IS NULL THEN backing ELSE 'clone' END AS backing, CASE WHEN c.chunk_id IS NULL THEN i.blob_id END AS blob_id, c.object_id,
  coalesce(c."offset", i."offset") AS "offset", coalesce(c.length, i.length) AS length, coalesce(c.seen_ms, i.last_seen_ms) AS last_seen_ms FROM index_ i FULL JOIN clones c USING (chunk_id))"""


def _cloned(spark, d):
    c = t.chunks(spark, d)
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    index = c.where("blob_id < 12").select("chunk_id", F.lit(storage.PACKED).alias("backing"), "blob_id", none.alias("object_id"), zero.alias("offset"), F.col("plaintext_length").alias("length"), "last_seen_ms")
    clones = c.where("blob_id > 8").select("chunk_id", (F.col("blob_id") + 100).alias("object_id"), (F.col("last_seen_ms") * 2).alias("offset"), F.col("plaintext_length").alias("length"), F.lit(9000).cast("bigint").alias("seen_ms"))
    return storage.ingest_clones(index, clones)


@query('SELECT chunk_id, backing, blob_id, object_id, "offset", length, last_seen_ms FROM cloned', INDEX)
def clone_ingest(spark, d):
    return _cloned(spark, d)


PROMOTED = f"""{INDEX}, {PACKED}, promoted AS (
  SELECT c.chunk_id, CASE WHEN m THEN 'packed' ELSE backing END AS backing, CASE WHEN m THEN pack ELSE blob_id END AS blob_id, CASE WHEN m THEN NULL ELSE object_id END AS object_id, CASE WHEN m THEN pack_offset ELSE "offset" END AS "offset", length, last_seen_ms
  FROM (SELECT c.*, p.pack, p.pack_offset, p.chunk_id IS NOT NULL AND backing = 'clone' AS m FROM cloned c LEFT JOIN (SELECT * FROM packed WHERE stream < 'a0') p USING (chunk_id)) c)"""


def _promoted(spark, d):
    return storage.promote(_cloned(spark, d), _packed(spark, d).where("stream < 'a0'"))


@query('SELECT chunk_id, backing, blob_id, object_id, "offset", length, last_seen_ms FROM promoted', PROMOTED)
def clone_promote(spark, d):
    return _promoted(spark, d)


@query("SELECT DISTINCT object_id FROM (SELECT blob_id + 100 AS object_id FROM chunks WHERE blob_id > 8) WHERE object_id NOT IN (SELECT object_id FROM promoted WHERE object_id > 112)", PROMOTED)
def dead_objects(spark, d):
    """Clone objects that no chunk lies in any more."""
    objects = t.chunks(spark, d).where("blob_id > 8").select((F.col("blob_id") + 100).alias("object_id")).distinct()
    return reach.dead_containers(objects, _promoted(spark, d).where("object_id > 112"), "object_id")


@query("SELECT DISTINCT 'o' || blob_id || CASE WHEN last_seen_ms % 2 = 0 THEN '.clone' ELSE '.blob' END AS path FROM chunks WHERE last_seen_ms % 2 = 0 AND blob_id >= 10")
def orphan_objects(spark, d):
    c = t.chunks(spark, d)
    listing = c.select(F.concat(F.lit("o"), "blob_id", F.when(F.col("last_seen_ms") % 2 == 0, ".clone").otherwise(".blob")).alias("path")).distinct()
    return storage.orphans(listing, c.where("blob_id < 10").select(F.concat(F.lit("o"), "blob_id", F.lit(".clone")).alias("path")))


@query("""SELECT path, CAST(sum(length) AS BIGINT) AS bytes, bool_and(blob_id < 18) AS repairable FROM manifests JOIN manifest_chunks USING (manifest_id) JOIN chunks USING (chunk_id)
WHERE NOT deleted AND seq % 4 = 0 GROUP BY path""")
def repair_missing(spark, d):
    m = t.manifests(spark, d)
    return storage.repairs(m, m.where("seq % 4 <> 0").select("path"), t.manifest_chunks(spark, d), t.chunks(spark, d).where("blob_id < 18"))


LIVE = "wanted AS (SELECT DISTINCT chunk_id FROM manifest_chunks WHERE manifest_id IN (SELECT manifest_id FROM live))"


def _live_chunks(spark, d):
    return t.manifest_chunks(spark, d).join(state.live(t.manifests(spark, d)), "manifest_id", "left_semi").select("chunk_id")


@query("SELECT chunk_id AS id FROM wanted UNION SELECT 'catalog' UNION SELECT 'pointer'", LIVE)
def needed_blobs(spark, d):
    return storage.needed(_live_chunks(spark, d), F.lit("catalog"), F.lit("pointer"))


@query("SELECT 1 AS step, chunk_id AS id FROM wanted WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE blob_id < 9) UNION ALL SELECT 2, 'catalog' UNION ALL SELECT 3, 'pointer'", LIVE)
def holder_reconcile(spark, d):
    held = t.chunks(spark, d).where("blob_id < 9").select(F.col("chunk_id").alias("id")).union(spark.range(1).select(F.lit("pointer")))
    return storage.holder_pushes(_live_chunks(spark, d), F.lit("catalog"), F.lit("pointer"), held)


@query("SELECT manifest_id, CAST(sum(length) AS BIGINT) AS bytes FROM manifest_chunks GROUP BY manifest_id")
def manifest_sizes(spark, d):
    lists = t.manifest_chunks(spark, d).groupBy("manifest_id").agg(F.collect_list(F.struct("ord", "length")).alias("chunks"))
    return lists.select("manifest_id", storage.total_length(F.col("chunks")).alias("bytes"))


@query("SELECT chunk_id, path, ord FROM manifests JOIN manifest_chunks USING (manifest_id) WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY path, ord) = 1 ORDER BY path, ord")
def first_seen_chunks(spark, d):
    """Each chunk of the live tree once, where it comes first."""
    rows = state.live(t.manifests(spark, d)).select("path", "manifest_id").join(t.manifest_chunks(spark, d), "manifest_id")
    return storage.first_seen(rows, "chunk_id", ["path", "ord"])


@query("SELECT substr(chunk_id, 1, 2) AS shard, count(*) AS blobs, CAST(sum(plaintext_length) AS BIGINT) AS bytes FROM chunks GROUP BY 1")
def blob_shards(spark, d):
    """The layout of a blob store: folders by the first byte of the id."""
    return t.chunks(spark, d).groupBy(F.substring("chunk_id", 1, 2).alias("shard")).agg(F.count("*").alias("blobs"), F.sum("plaintext_length").alias("bytes"))


FOLDERS = "folders AS (SELECT n_name AS folder_id, 's' || n_nationkey AS share_id, CASE WHEN n_nationkey % 3 = 0 THEN 'k' || n_nationkey END AS key, n_nationkey % 4 = 0 AS holder, n_nationkey % 8 <> 0 AS encrypted FROM nation)"


def _folders(spark, d):
    k = F.col("n_nationkey")
    return t.table(spark, d, "nation").select(F.col("n_name").alias("folder_id"), F.concat(F.lit("s"), k).alias("share_id"), F.when(k % 3 == 0, F.concat(F.lit("k"), k)).alias("key"), (k % 4 == 0).alias("holder"), (k % 8 != 0).alias("encrypted"))


@query("SELECT folder_id, share_id, key, holder, encrypted FROM folders ORDER BY folder_id", FOLDERS)
def folder_configs(spark, d):
    return _folders(spark, d).orderBy("folder_id")


@query("SELECT folder_id FROM folders WHERE holder AND NOT encrypted", FOLDERS)
def config_violations(spark, d):
    return storage.config_violations(_folders(spark, d)).select("folder_id")


@query("""SELECT folder_id, coalesce(share, f.share_id, folder_id) AS share_id, coalesce(f.key, c.key) AS key FROM folders f FULL JOIN (
  SELECT folder_id, max_by(op, "at") FILTER (op IN ('add', 'remove')) AS there, max_by(value, "at") FILTER (op = 'share') AS share, min_by(value, "at") FILTER (op = 'key') AS key FROM changes GROUP BY folder_id) c USING (folder_id)
WHERE coalesce(there = 'add', f.share_id IS NOT NULL)""",
FOLDERS + """, changes AS (SELECT n_name AS folder_id, ['add', 'share', 'key', 'remove', 'share'][event_id % 5 + 1] AS op, 'v' || event_id AS value, event_id AS "at" FROM events JOIN (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 25, r_name || ' 2' FROM region) names ON n_nationkey = event_id % 31)""")
def config_changes(spark, d):
    e = t.table(spark, d, "events").select((F.col("event_id") % 31).cast("int").alias("n_nationkey"), "event_id")
    op = _pick(("add", "share", "key", "remove", "share"), F.col("event_id") % 5)
    # regions give the names of folders that are not there yet
    names = t.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("folder_id")).union(t.table(spark, d, "region").select(F.col("r_regionkey") + 25, F.concat("r_name", F.lit(" 2"))))
    changes = e.join(names, "n_nationkey").select("folder_id", op.alias("op"), F.concat(F.lit("v"), "event_id").alias("value"), F.col("event_id").alias("at"))
    return storage.configured(_folders(spark, d).select("folder_id", "share_id", "key"), changes)
