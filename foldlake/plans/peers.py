"""Queries over peers: version vectors and conflicts, rosters and roles, receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlake.operators import members, state, sync, vectors
from foldlake.plans.relations import query
from foldlake.sources import tables as t

VERSIONS = """a AS (SELECT path, author AS node, count(*) AS counter FROM feed WHERE seq % 2 = 0 GROUP BY ALL),
b AS (SELECT path, author AS node, count(*) AS counter FROM feed WHERE seq % 3 = 0 GROUP BY ALL),
pairs AS (SELECT path, node, coalesce(a.counter, 0) AS x, coalesce(b.counter, 0) AS y FROM a FULL JOIN b USING (path, node)),
compared AS (
  SELECT path, CASE WHEN bool_and(x <= y) AND bool_and(x >= y) THEN 'equal' WHEN bool_and(x >= y) THEN 'greater' WHEN bool_and(x <= y) THEN 'less' ELSE 'concurrent' END AS ordering,
    string_agg(node || ':' || greatest(x, y), ',' ORDER BY node) AS jv, string_agg(node || ':' || x, ',' ORDER BY node) FILTER (x > 0) AS lv, string_agg(node || ':' || y, ',' ORDER BY node) FILTER (y > 0) AS rv
  FROM pairs GROUP BY path)"""
BOTH = "path IN (SELECT path FROM a) AND path IN (SELECT path FROM b)"
CONFLICT_NAME = "replace(path, '.txt', '') || '.conflict-' || strftime(make_timestamp(authored_ms * 1000), '%Y%m%dT%H%M%S.%gZ') || '-' || author || '.txt'"


def _changes(spark, d, every):
    return t.feed(spark, d).where(F.col("seq") % every == 0).select("path", F.col("author").alias("node"))


def _vectors(spark, d):
    a = vectors.from_rows(_changes(spark, d, 2), "path").withColumnRenamed("vector", "a")
    return a.join(vectors.from_rows(_changes(spark, d, 3), "path").withColumnRenamed("vector", "b"), "path")


def _text(vector):
    return F.array_join(F.transform(F.array_sort(F.map_entries(vector)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


@query(f"SELECT path, ordering FROM compared WHERE {BOTH}", VERSIONS)
def vv_compare(spark, d):
    return _vectors(spark, d).select("path", vectors.compare(F.col("a"), F.col("b")).alias("ordering"))


@query(f"SELECT path, ordering FROM compared WHERE {BOTH}", VERSIONS)
def vv_compare_long(spark, d):
    long = lambda every: _changes(spark, d, every).groupBy("path", "node").agg(F.count("*").alias("counter"))
    return vectors.compare_long(long(2), long(3))


@query(f"SELECT path, ordering IN ('equal', 'greater') AS dominates, ordering = 'concurrent' AS is_concurrent FROM compared WHERE {BOTH}", VERSIONS)
def vv_dominates(spark, d):
    a, b = F.col("a"), F.col("b")
    return _vectors(spark, d).select("path", vectors.dominates(a, b).alias("dominates"), (vectors.compare(a, b) == "concurrent").alias("is_concurrent"))


@query(f"SELECT path, jv AS vector FROM compared WHERE {BOTH}", VERSIONS)
def vv_join(spark, d):
    return _vectors(spark, d).select("path", _text(vectors.join(F.col("a"), F.col("b"))).alias("vector"))


@query("SELECT path, node, max(counter) AS counter FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY path, node", VERSIONS)
def vv_join_long(spark, d):
    long = lambda every: _changes(spark, d, every).groupBy("path", "node").agg(F.count("*").alias("counter"))
    return vectors.join_long(long(2).union(long(3)))


@query("""SELECT path, string_agg(node || ':' || n, ',' ORDER BY node) AS vector FROM (
  SELECT path, node, sum(counter)::BIGINT AS n FROM (SELECT * FROM a UNION ALL SELECT DISTINCT path, 'n0', 1 FROM a) GROUP BY path, node) GROUP BY path""", VERSIONS)  # fmt: skip
def vv_bump(spark, d):
    own = vectors.from_rows(_changes(spark, d, 2), "path")
    return own.select("path", _text(vectors.bump(F.col("vector"), "n0")).alias("vector"))


def _by_author(spark, d):
    return state.latest(t.feed(spark, d).select("path", "author", "seq", "manifest_id", "authored_ms", "deleted"), ["path", "author"])


BY_AUTHOR = "by_author AS (SELECT path, author, seq, manifest_id, authored_ms, deleted FROM feed QUALIFY row_number() OVER (PARTITION BY path, author ORDER BY seq DESC) = 1)"


@query("SELECT path, author, authored_ms, manifest_id FROM by_author QUALIFY row_number() OVER (PARTITION BY path ORDER BY authored_ms DESC, author DESC) = 1", BY_AUTHOR)
def conflict_winner(spark, d):
    return vectors.winner(_by_author(spark, d).select("path", "author", "authored_ms", "manifest_id"))


@query(f"SELECT seq, {CONFLICT_NAME} AS copy_path FROM feed")
def conflict_paths(spark, d):
    f = t.feed(spark, d)
    return f.select("seq", vectors.conflict_path(F.col("path"), F.col("author"), F.col("authored_ms")).alias("copy_path"))


LONG = "CASE WHEN seq % 3 = 0 THEN '.rc' ELSE 'd/' END || repeat('x', seq % 270) || CASE WHEN seq % 2 = 0 THEN '.tar' ELSE '' END"
TAIL = "'.conflict-' || strftime(make_timestamp(authored_ms * 1000), '%Y%m%dT%H%M%S.%gZ') || '-' || author"


@query(f"""SELECT seq, dir || substr(stem, 1, greatest(255 - length(tail) - length(ext), 0)) || tail || ext AS copy_path FROM (
  SELECT seq, tail, CASE WHEN seq % 3 = 0 THEN '' ELSE 'd/' END AS dir, CASE WHEN base LIKE '%.tar' AND base <> '.tar' THEN '.tar' ELSE '' END AS ext, CASE WHEN base LIKE '%.tar' AND base <> '.tar' THEN left(base, -4) ELSE base END AS stem
  FROM (SELECT seq, {TAIL} AS tail, CASE WHEN seq % 3 = 0 THEN path ELSE substr(path, 3) END AS base FROM (SELECT seq, author, authored_ms, {LONG} AS path FROM feed)))""")
def conflict_paths_long(spark, d):
    """Names around the limit of 255 bytes, dotfiles and names without an extension among them."""
    f, n = t.feed(spark, d), F.col("seq")
    path = F.concat(F.when(n % 3 == 0, ".rc").otherwise("d/"), F.repeat(F.lit("x"), (n % 270).cast("int")), F.when(n % 2 == 0, ".tar").otherwise(""))
    return f.select("seq", vectors.conflict_path(path, F.col("author"), F.col("authored_ms")).alias("copy_path"))


@query(f"""SELECT CASE WHEN n = 1 THEN path ELSE {CONFLICT_NAME} END AS path, manifest_id, author, n > 1 AS copy
FROM (SELECT *, row_number() OVER w AS n, first_value(manifest_id) OVER w AS best FROM by_author WHERE NOT deleted WINDOW w AS (PARTITION BY path ORDER BY authored_ms DESC, author DESC))
WHERE n = 1 OR manifest_id <> best""", BY_AUTHOR)  # fmt: skip
def conflict_converge(spark, d):
    return vectors.converge(_by_author(spark, d).where("NOT deleted").select("path", "manifest_id", "author", "authored_ms"))


#: Local and incoming versions of every path, with the vectors of VERSIONS, as the SQL below needs them.
MERGE = (
    VERSIONS
    + """, met AS (
  SELECT r.path, CASE WHEN l.path IS NULL THEN 'new' ELSE ordering END AS ordering, jv, lv, rv, l.manifest_id AS lm, l.author AS la, l.authored_ms AS lt, l.deleted AS ld,
    r.manifest_id AS rm, r.author AS ra, r.authored_ms AS rt, r.deleted AS rd, CASE WHEN l.authored_ms <> r.authored_ms THEN l.authored_ms > r.authored_ms ELSE l.author > r.author END AS lw
  FROM (SELECT path, manifest_id, author, authored_ms, deleted FROM feed WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) r
  LEFT JOIN (SELECT path, manifest_id, author, authored_ms, deleted FROM feed WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) l USING (path) JOIN compared USING (path)),
clash AS (SELECT * FROM met WHERE ordering = 'concurrent' AND ld = rd AND lm <> rm)"""
)


@query(f"""SELECT path, rm AS manifest_id, rv AS vector, ra AS author, rt AS authored_ms, rd AS deleted, CASE ordering WHEN 'new' THEN 'new' ELSE 'newer' END AS action FROM met WHERE ordering IN ('new', 'less')
UNION ALL SELECT path, rm, jv, ra, rt, rd, 'edit over delete' FROM met WHERE ordering = 'concurrent' AND ld AND NOT rd
UNION ALL SELECT path, lm, jv, la, lt, ld, 'edit over delete' FROM met WHERE ordering = 'concurrent' AND rd AND NOT ld
UNION ALL SELECT path, rm, jv, CASE WHEN lw THEN la ELSE ra END, CASE WHEN lw THEN lt ELSE rt END, rd, 'merged' FROM met WHERE ordering = 'concurrent' AND ld = rd AND lm = rm
UNION ALL SELECT path, CASE WHEN lw THEN lm ELSE rm END, jv, CASE WHEN lw THEN la ELSE ra END, CASE WHEN lw THEN lt ELSE rt END, ld, 'winner' FROM clash
UNION ALL SELECT {CONFLICT_NAME}, manifest_id, vector, author, authored_ms, false, 'copy' FROM (
  SELECT path, CASE WHEN lw THEN rm ELSE lm END AS manifest_id, CASE WHEN lw THEN rv ELSE lv END AS vector, CASE WHEN lw THEN ra ELSE la END AS author, CASE WHEN lw THEN rt ELSE lt END AS authored_ms FROM clash WHERE NOT ld)""", MERGE)  # fmt: skip
def delta_apply(spark, d):
    def side(every):
        last = state.latest(t.feed(spark, d).where(F.col("seq") % every == 0).select("path", "seq", "manifest_id", "author", "authored_ms", "deleted"))
        return last.join(vectors.from_rows(_changes(spark, d, every), "path"), "path")

    return vectors.resolve(side(2), side(3)).withColumn("vector", _text(F.col("vector")))


@query("SELECT node_id, added_by, role, depth FROM roster")
def roster_closure(spark, d):
    return members.closure(t.members(spark, d), 1)


CIRCLES = """entries AS (
  SELECT node_id, added_by, role, sig_ok FROM members UNION ALL SELECT node_id, node_id * 2, role, true FROM members UNION ALL SELECT node_id, node_id + 1, role, node_id % 2 = 0 FROM members),
ring AS (
  SELECT node_id, added_by, role, 0 AS depth FROM entries WHERE sig_ok AND node_id = 1 AND added_by = 1 AND role = 1
  UNION
  SELECT e.node_id, 0, e.role, depth + 1 FROM entries e JOIN ring r ON e.added_by = r.node_id WHERE e.sig_ok AND r.role = 1 AND e.node_id <> e.added_by AND depth < 24),
reached AS (SELECT node_id, any_value(role) AS role, min(depth) AS depth FROM ring GROUP BY node_id)"""


@query("""SELECT r.node_id, min(CASE WHEN r.depth = 0 THEN 1 ELSE e.added_by END) AS added_by, r.role, r.depth FROM reached r JOIN entries e ON e.node_id = r.node_id AND e.sig_ok
LEFT JOIN reached s ON s.node_id = e.added_by WHERE r.depth = 0 OR (s.role = 1 AND s.depth = r.depth - 1 AND e.node_id <> e.added_by) GROUP BY r.node_id, r.role, r.depth""", CIRCLES)
def roster_circles(spark, d):
    """A roster whose entries sign each other in circles, several of them for one node."""
    m = t.members(spark, d)
    k = F.col("node_id")
    more = m.select(k, (k * 2).alias("added_by"), "role", F.lit(True).alias("sig_ok")).union(m.select(k, k + 1, "role", k % 2 == 0))
    return members.closure(m.union(more), 1)


ROLES = "roles AS (SELECT m.node_id, CASE WHEN m.node_id = 1 THEN 1 ELSE r.role END AS role FROM members m LEFT JOIN roster r USING (node_id))"


def _roles(spark, d):
    m = t.members(spark, d)
    return members.effective_roles(m, members.closure(m, 1), 1)


@query("SELECT node_id, role FROM roles", ROLES)
def role_effective(spark, d):
    return _roles(spark, d)


@query("SELECT m.node_id AS self, m.added_by AS peer, coalesce(s.role = 1 AND p.role IN (0, 1), false) AS deliver FROM members m LEFT JOIN roles s ON s.node_id = m.node_id LEFT JOIN roles p ON p.node_id = m.added_by", ROLES)
def key_delivery(spark, d):
    return members.may_receive_key(t.members(spark, d).select(F.col("node_id").alias("self"), F.col("added_by").alias("peer")), _roles(spark, d))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown folder' WHEN s_suppkey % 6 = 0 THEN 'holder folder' WHEN s_suppkey % 3 <> 1 THEN 'not a writer'
  WHEN s_suppkey % 11 = 0 THEN 'bad length' WHEN s_suppkey % 4 = 1 THEN 'verifier mismatch' WHEN s_suppkey % 13 = 0 THEN 'already set' ELSE 'stored' END AS outcome FROM supplier""")  # fmt: skip
def key_acceptance(spark, d):
    k = F.col("s_suppkey")
    verifier_ok = F.when(k % 4 == 0, None).otherwise(k % 4 != 1)
    out = members.key_outcome(k % 7 != 0, k % 6 == 0, k % 3, F.when(k % 11 == 0, 16).otherwise(32), verifier_ok, k % 13 == 0)
    return t.table(spark, d, "supplier").select(k.alias("id"), out.alias("outcome"))


@query("SELECT seq, path, author FROM feed WHERE author IN (SELECT 'n' || node_id FROM roles WHERE role = 1)", ROLES)
def writer_authored(spark, d):
    roles = _roles(spark, d).select(F.concat(F.lit("n"), F.col("node_id")).alias("node_id"), "role")
    return members.writer_authored(t.feed(spark, d).select("seq", "path", "author"), roles)


OFFERS = """mine AS (SELECT n_name AS folder_id, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'v' || n_nationkey % 2 END AS verifier FROM nation),
theirs AS (SELECT n_name AS folder_id, 'v' || n_regionkey % 2 AS verifier FROM nation WHERE n_nationkey % 4 <> 0)"""


@query("SELECT folder_id, CASE WHEN m.verifier <> '' AND t.verifier <> '' AND m.verifier <> t.verifier THEN 'mismatched' ELSE 'shared' END AS state FROM mine m JOIN theirs t USING (folder_id)", OFFERS)
def folder_intersection(spark, d):
    n = t.table(spark, d, "nation")
    mine = n.select(F.col("n_name").alias("folder_id"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("n_nationkey") % 2)).alias("verifier"))
    theirs = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("folder_id"), F.concat(F.lit("v"), F.col("n_regionkey") % 2).alias("verifier"))
    return members.intersect_offers(mine, theirs)


@query("SELECT n_name AS folder_id FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 1 AND n_name <> ''")
def folder_offers(spark, d):
    n = t.table(spark, d, "nation").withColumnRenamed("n_name", "folder_id")
    return members.offered(n.where("n_nationkey % 2 = 0").select("folder_id"), n.where("n_regionkey <> 1"))


@query("SELECT DISTINCT s_suppkey AS node_id FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 7) AND s_suppkey <> 7")
def co_members(spark, d):
    return members.co_members(t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("network_id"), F.col("s_suppkey").alias("node_id")), 7)


@query("SELECT n_nationkey AS network_id FROM nation WHERE n_regionkey = 3 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3)")
def authorized_groups(spark, d):
    groups = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("network_id"), F.col("n_regionkey").alias("founder_id"))
    return members.authorized(groups, t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("network_id")), 3)


@query("""SELECT node_id, role, added_at_ms FROM held UNION ALL
SELECT user_id, event_id % 3, event_id FROM events WHERE user_id NOT IN (SELECT node_id FROM held) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
"held AS (SELECT user_id AS node_id, event_id % 3 AS role, event_id AS added_at_ms FROM events WHERE event_id <= 90 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)")
def roster_insert(spark, d):
    entries = t.table(spark, d, "events").select(F.col("user_id").alias("node_id"), (F.col("event_id") % 3).alias("role"), F.col("event_id").alias("added_at_ms"))
    early = entries.where("added_at_ms <= 90")
    return members.first_writer_wins(members.first_writer_wins(early.where("false"), early), entries)


@query("""SELECT DISTINCT (n + 1) % 10 AS peer, entry FROM held_ h WHERE NOT EXISTS (SELECT 1 FROM held_ o WHERE o.n = (h.n + 1) % 10 AND o.entry = h.entry)""",
"held_ AS (SELECT DISTINCT user_id % 10 AS n, event_id // 3 AS entry FROM events)")
def gossip_round(spark, d):
    """One round over all events: an entry stands for three of them, which up to three nodes hold."""
    held = t.table(spark, d, "events").select((F.col("user_id") % 10).alias("node_id"), F.floor(F.col("event_id") / 3).alias("entry")).distinct()
    links = spark.range(10).select(F.col("id").alias("node_id"), ((F.col("id") + 1) % 10).alias("peer"))
    return members.gossip_round(held, links, cap=1 << 40)


@query("SELECT n AS node_id, count(DISTINCT entry) AS entries FROM (SELECT event_id // 3 AS entry FROM events), range(10) r(n) GROUP BY n")
def gossip_settled(spark, d):
    """After rounds on a ring until nothing is new every node holds every entry."""
    held = t.table(spark, d, "events").select((F.col("user_id") % 10).alias("node_id"), F.floor(F.col("event_id") / 3).alias("entry"))
    links = spark.range(10).select(F.col("id").alias("node_id"), ((F.col("id") + 1) % 10).alias("peer"))
    return sync.gossip(held, links, cap=1 << 40).groupBy("node_id").agg(F.count("*").alias("entries"))


@query("SELECT user_id % 20 AS peer_id, event_type AS direction, event_id % 2 AS epoch, event_id AS high_water, event_id AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY event_id DESC) = 1")
def receipt_latest(spark, d):
    e = F.col("event_id")
    return members.latest_receipts(t.table(spark, d, "events").select((F.col("user_id") % 20).alias("peer_id"), F.col("event_type").alias("direction"), (e % 2).alias("epoch"), e.alias("high_water"), e.alias("at")))


@query("SELECT peer_id, epoch, least(high_water, 9900) AS high_water FROM receipts WHERE epoch = 1")
def receipt_sanitize(spark, d):
    return members.sane_receipts(t.receipts(spark, d), 1, 9900)


@query("""SELECT k AS wanted, count(*) > 0 AS gated, CAST(CASE WHEN bool_or(epoch IS NULL OR epoch <> 1) THEN 0 ELSE min(high_water) END AS BIGINT) AS high_water
FROM (VALUES (3), (19), (0)) w(k) LEFT JOIN (SELECT p, 'p' || p AS peer_id FROM range(20) x(p)) g ON g.p BETWEEN k AND k + 2 LEFT JOIN receipts USING (peer_id) GROUP BY k""")  # fmt: skip
def converged_high_water(spark, d):
    out = None
    for k in (3, 19, 0):
        peers = spark.range(k, min(k + 3, 20)).select(F.concat(F.lit("p"), "id").alias("peer_id"))
        one = members.converged_high_water(peers, t.receipts(spark, d), 1).select(F.lit(k).alias("wanted"), "gated", F.col("high_water").cast("bigint").alias("high_water"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT event_id, peer_id FROM (SELECT event_id, user_id AS peer_id, event_id % 2 = 0 AS mine FROM events WHERE user_id <> 50)
QUALIFY row_number() OVER (PARTITION BY peer_id ORDER BY CASE WHEN peer_id > 50 THEN NOT mine ELSE mine END, event_id) = 1""")  # fmt: skip
def one_session(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.col("user_id").alias("peer_id"), F.lit(50).cast("bigint").alias("self_id"), F.col("event_id").alias("at"))
    # on a tie of ids the session counts as the peer's
    mine = e.withColumn("initiator_id", F.when(F.col("event_id") % 2 == 0, F.col("self_id")).otherwise(F.col("peer_id"))).where("peer_id <> 50")
    return members.one_session(mine).select("event_id", "peer_id")
