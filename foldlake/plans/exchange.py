"""Queries over the exchange between replicas: delta rows, cursors, announcements, routing, group facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlake.functions import columns
from foldlake.operators import control, folds, members, merkle, network, sync
from foldlake.plans.relations import MERKLE, query, sql_base32
from foldlake.sources import tables as t


@query("""SELECT path, manifest_id, seq, author, authored_ms, deleted, CASE WHEN deleted THEN authored_ms END AS deleted_ms, coalesce(chunks, '') AS chunks FROM manifests
LEFT JOIN (SELECT manifest_id, string_agg(chunk_id || ':' || length, ',' ORDER BY ord) AS chunks FROM manifest_chunks GROUP BY manifest_id) USING (manifest_id)""")
def local_as_delta(spark, d):
    """Local rows as a peer gets them."""
    delta = sync.as_delta(t.manifests(spark, d), t.manifest_chunks(spark, d))
    text = F.array_join(F.transform("chunks", lambda c: F.concat(c["chunk_id"], F.lit(":"), c["length"])), ",")
    return delta.withColumn("chunks", text)


KINDS = "CASE WHEN seq % 4 = 0 THEN 'symlink' ELSE 'regular' END"


def _delta(spark, d):
    delta = sync.as_delta(t.manifests(spark, d), t.manifest_chunks(spark, d))
    return delta.withColumn("kind", F.when(F.col("seq") % 4 == 0, "symlink").otherwise("regular")).withColumn("deleted_ms", F.when(F.col("seq") % 3 != 0, F.col("deleted_ms")).otherwise(F.lit(0).cast("bigint")))


@query("""SELECT path, size, CASE WHEN deleted THEN CASE WHEN seq % 3 <> 0 THEN authored_ms ELSE 99 END END AS deleted_ms FROM manifests JOIN (SELECT manifest_id, CAST(sum(length) AS BIGINT) AS size FROM manifest_chunks GROUP BY manifest_id) USING (manifest_id)""")
def delta_decode(spark, d):
    """Rows of a delta with their size; a deletion without a time counts from now."""
    return sync.decoded(_delta(spark, d), 99)[0].select("path", "size", "deleted_ms")


@query("SELECT DISTINCT chunk_id, length FROM manifests JOIN manifest_chunks USING (manifest_id) WHERE NOT deleted AND seq % 4 <> 0")
def delta_pull(spark, d):
    """Chunks to fetch for a delta: of live regular files."""
    return sync.decoded(_delta(spark, d), 99)[1]


@query("SELECT peer_id, CASE WHEN epoch = 1 THEN high_water ELSE 0 END AS since FROM receipts")
def delta_start(spark, d):
    return sync.start(t.receipts(spark, d), 1)


CURSORS = "cursors AS (SELECT 'f' || n AS folder, peer_id, epoch, high_water FROM receipts, range(3) r(n)), moved AS (SELECT 'f' || event_id % 4 AS folder, 'p' || user_id % 20 AS peer_id, event_id % 2 AS epoch, event_id AS high_water, event_id AS \"at\" FROM events WHERE event_type = 'view')"


@query("""SELECT * FROM cursors ANTI JOIN moved USING (folder, peer_id) UNION ALL
SELECT folder, peer_id, epoch, high_water FROM moved QUALIFY row_number() OVER (PARTITION BY folder, peer_id ORDER BY "at" DESC) = 1""", CURSORS)  # fmt: skip
def cursor_advance(spark, d):
    cursors = t.receipts(spark, d).select(F.explode(F.array(*map(F.lit, ("f0", "f1", "f2")))).alias("folder"), "peer_id", "epoch", "high_water")
    e = F.col("event_id")
    moved = t.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("f"), e % 4).alias("folder"), F.concat(F.lit("p"), F.col("user_id") % 20).alias("peer_id"), (e % 2).alias("epoch"), e.alias("high_water"), e.alias("at"))
    return sync.advanced(cursors, moved)


@query("""SELECT peer_id, CASE WHEN same AND r.epoch IS NOT DISTINCT FROM 1 AND r.high_water IS NOT DISTINCT FROM hw THEN 'nothing' WHEN same THEN 'cursor' ELSE 'pull' END AS action, CASE WHEN NOT same THEN CASE WHEN r.epoch = 1 THEN r.high_water ELSE 0 END END AS since
FROM (SELECT 'p' || n AS peer_id, n % 3 <> 1 AS same, CASE WHEN n % 2 = 0 THEN coalesce(x.high_water, 7) ELSE 7 END AS hw FROM range(20) k(n) LEFT JOIN receipts x ON x.peer_id = 'p' || n) LEFT JOIN receipts r USING (peer_id)""")
def reconcile_plan(spark, d):
    """What announcements of twenty peers lead to: equal roots move the cursor at most."""
    receipts = t.receipts(spark, d)
    n = F.col("id")
    peers = spark.range(20).select(F.concat(F.lit("p"), n).alias("peer_id"), F.when(n % 3 != 1, "here").otherwise("there").alias("root"), F.lit(1).cast("bigint").alias("epoch"), (n % 2 == 0).alias("_even"))
    known = peers.join(receipts.select("peer_id", F.col("high_water").alias("_h")), "peer_id", "left")
    announced = known.select("peer_id", "root", "epoch", F.when(F.col("_even"), F.coalesce("_h", F.lit(7))).otherwise(7).cast("bigint").alias("high_water"))
    return sync.plan(announced, spark.range(1).select(F.lit("here").alias("root")), receipts)


@query("SELECT event_id % 5 AS folder, event_id // 97 AS batch, max_by('r' || event_id % 13, event_id) AS root, max(event_id) AS high_water, count(*) AS announced FROM events GROUP BY 1, 2")
def announce_coalesced(spark, d):
    e = F.col("event_id")
    rows = t.table(spark, d, "events").select((e % 5).alias("folder"), F.concat(F.lit("r"), e % 13).alias("root"), e.alias("high_water"), e.alias("at"))
    return sync.coalesced(rows, F.floor(F.col("at") / 97))


@query("SELECT folder, h AS root, 1 AS epoch, high_water FROM tree JOIN (SELECT split_part(path, '/', 1) AS folder, max(seq) AS high_water FROM manifests GROUP BY 1) ON g = folder WHERE n = 1",
"leaf AS (SELECT split_part(path, '/', 1) AS g, path, manifest_id, deleted FROM manifests), " + MERKLE)
def folder_announces(spark, d):
    """The periodic announcement of every folder: root, epoch and high-water mark."""
    m = t.manifests(spark, d).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1)))
    high = m.groupBy("folder").agg(F.max("seq").alias("high_water"))
    return merkle.roots(m, "folder").join(high, "folder").select("folder", "root", F.lit(1).alias("epoch"), "high_water")


@query("""SELECT folder, min(at_ms) AS start_ms, max(at_ms) + 7200000 AS cut_ms, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY at_ms) AS burst FROM (
    SELECT event_id % 20 AS folder, epoch_us(ts) // 1000 AS at_ms, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_id % 20 ORDER BY ts) < 7200000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY folder, burst""")
def quiesce_cuts(spark, d):
    """Snapshots after a quiet time: one per burst of a folder, when it has been quiet for two hours."""
    e = t.table(spark, d, "events").select((F.col("event_id") % 20).alias("folder"), F.col("event_id").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return control.bursts(e, 7_200_000).select("folder", "start_ms", (F.col("last_ms") + 7_200_000).alias("cut_ms"), "events")


@query("""SELECT folder, 300000 + delay AS every_ms, (last_ms - first_ms) // (300000 + delay) AS scans FROM (SELECT folder, first_ms, last_ms, CAST('0x' || substr(sha256(folder), 1, 8) AS BIGINT) % 30000 AS delay
  FROM (SELECT 'u' || user_id AS folder, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id))""")
def rescan_schedule(spark, d):
    """Periodic scans: five minutes and a delay of each folder's own."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    folders = t.table(spark, d, "events").groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("folder")).agg(F.min(at).alias("first_ms"), F.max(at).alias("last_ms"))
    return control.rescans(folders, 300_000, 30_000)


CHANGES = "paths AS (SELECT 'u' || user_id % 40 AS folder, 'f' || event_id % 7 AS path, epoch_us(ts) // 1000 AS at_ms FROM events)"


def _sql_bursts(gap: int) -> str:
    return f"""(SELECT folder, path, max(at_ms) OVER (PARTITION BY folder, burst) AS last_ms FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY at_ms) AS burst FROM (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY folder ORDER BY at_ms) < {gap} THEN 0 ELSE 1 END AS fresh FROM paths)))"""


WAITS = dict(debounce_ms=7_200_000, quiesce_ms=14_400_000, period_ms=86_400_000, jitter_ms=3_600_000)


@query(f"""SELECT DISTINCT folder, last_ms + {WAITS["debounce_ms"]} AS "at", 'scan' AS kind, path FROM {_sql_bursts(WAITS["debounce_ms"])}
UNION ALL SELECT DISTINCT folder, last_ms + {WAITS["quiesce_ms"]}, 'snapshot', NULL FROM {_sql_bursts(WAITS["quiesce_ms"])}
UNION ALL SELECT folder, unnest(range(first_ms + every_ms, last_ms + 1, every_ms)), 'rescan', NULL FROM (
  SELECT folder, min(at_ms) AS first_ms, max(at_ms) AS last_ms, {WAITS["period_ms"]} + CAST('0x' || substr(sha256(folder), 1, 8) AS BIGINT) % {WAITS["jitter_ms"]} AS every_ms FROM paths GROUP BY folder)""", CHANGES)
def control_requests(spark, d):
    """Scans of dirty paths, snapshots and rescans of forty folders, with times that fit the events."""
    e = t.table(spark, d, "events")
    changes = e.select(F.concat(F.lit("u"), F.col("user_id") % 40).alias("folder"), F.concat(F.lit("f"), F.col("event_id") % 7).alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return control.requests(changes, **WAITS)


TAKES = 4 * 3_600_000
#: The fold of runs over each folder's changes: what was begun last, and whether one more run is due.
PUSHED = f"""changes AS (SELECT 'u' || user_id AS folder, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS n FROM events),
runs AS (
  SELECT folder, at_ms, n, at_ms AS begun, false AS due, 1::BIGINT AS total, [at_ms] AS made FROM changes WHERE n = 1
  UNION ALL
  SELECT c.folder, c.at_ms, c.n, CASE WHEN c.at_ms >= s.begun + {TAKES} THEN c.at_ms ELSE s.begun END, c.at_ms < s.begun + {TAKES},
    s.total + (s.ran)::INT + (c.at_ms >= s.begun + {TAKES})::INT, CASE WHEN s.ran THEN [s.begun] ELSE []::BIGINT[] END || CASE WHEN c.at_ms >= s.begun + {TAKES} THEN [c.at_ms] ELSE []::BIGINT[] END
  FROM changes c JOIN (
    SELECT r.folder, r.n, r.total, r.due AND x.at_ms >= r.begun + {TAKES} AS ran, CASE WHEN r.due AND x.at_ms >= r.begun + {TAKES} THEN r.begun + {TAKES} ELSE r.begun END AS begun, CASE WHEN r.due AND x.at_ms < r.begun + {TAKES} THEN true ELSE false END AS due
    FROM runs r JOIN changes x ON x.folder = r.folder AND x.n = r.n + 1) s ON c.folder = s.folder AND c.n = s.n + 1)"""


@query(f"""SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY start_ms) - 1 AS run, start_ms FROM (
  SELECT folder, unnest(made) AS start_ms FROM runs UNION ALL SELECT folder, begun + {TAKES} FROM runs WHERE due QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC) = 1 AND n = (SELECT max(n) FROM changes c WHERE c.folder = runs.folder))""", PUSHED)
def push_runs(spark, d):
    """Pushes to a holder that take four hours: changes meanwhile lead to one more."""
    changes = t.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("folder"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return sync.pushes(changes, TAKES)


PRESENCE = """presence AS (SELECT user_id % 40 AS node_id, event_id AS at, event_type <> 'error' AS up, 'a' || event_id AS address FROM events WHERE event_id % 3 = 0),
asked AS (SELECT event_id AS id, event_id AS at, user_id % 50 AS from_id, event_id % 50 AS to_id FROM events WHERE event_id % 3 <> 0)"""


@query("""SELECT id, CASE WHEN ok THEN 'brokered' ELSE 'unavailable' END AS outcome, CASE WHEN ok THEN address END AS address FROM (
  SELECT a.id, coalesce(p.up, false) AND a.from_id <> a.to_id AS ok, p.address FROM asked a ASOF LEFT JOIN presence p ON p.node_id = a.to_id AND a.at >= p.at)""", PRESENCE)  # fmt: skip
def signal_routes(spark, d):
    """Connect requests against who is connected at that moment."""
    e, u = F.col("event_id"), F.col("user_id")
    events = t.table(spark, d, "events")
    presence = events.where(e % 3 == 0).select((u % 40).alias("node_id"), e.alias("at"), (F.col("event_type") != "error").alias("up"), F.concat(F.lit("a"), e).alias("address"))
    asked = events.where(e % 3 != 0).select(e.alias("id"), e.alias("at"), (u % 50).alias("from_id"), (e % 50).alias("to_id"))
    return sync.routed(asked, presence)


PLACES = 3
#: Connections and requests of a server's nodes in order, as a recursive relation; a connection is named by a span of the node's events.
BROKER = f"""visits AS (SELECT event_id AS id, user_id AS node, user_id // 5 AS server, CASE event_id % 6 WHEN 0 THEN 'up' WHEN 1 THEN 'up' WHEN 2 THEN 'down' WHEN 3 THEN 'malformed' ELSE 'request' END AS kind,
  CASE WHEN event_id % 6 = 2 THEN event_id + 300 ELSE event_id END // 1000 AS conn, user_id // 5 * 5 + event_id % 5 AS target, row_number() OVER (PARTITION BY user_id // 5 ORDER BY event_id) AS k FROM events),
brokered AS (
  SELECT server, 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS node, '' AS outcome, NULL::BIGINT AS other, []::STRUCT(n BIGINT, c BIGINT)[] AS held FROM (SELECT DISTINCT server FROM visits)
  UNION ALL
  SELECT server, k, id, node, CASE WHEN kind = 'up' THEN CASE WHEN own IS NOT NULL THEN 'replaced' WHEN len(was) >= {PLACES} THEN 'refused' ELSE 'connected' END
      WHEN own IS DISTINCT FROM conn THEN CASE kind WHEN 'down' THEN 'stale' ELSE 'not connected' END WHEN kind = 'down' THEN 'closed' WHEN kind = 'malformed' THEN 'bad request' WHEN target = node OR goes IS NULL THEN 'unavailable' ELSE 'brokered' END,
    CASE WHEN kind = 'up' THEN own WHEN kind = 'request' AND own = conn AND target <> node THEN goes END,
    CASE WHEN kind = 'up' AND (own IS NOT NULL OR len(was) < {PLACES}) THEN list_filter(was, lambda x: x.n <> node) || [{{'n': node, 'c': conn}}] WHEN kind = 'down' AND own = conn THEN list_filter(was, lambda x: x.n <> node) ELSE was END
  FROM (SELECT v.*, l.held AS was, list_filter(l.held, lambda x: x.n = v.node)[1].c AS own, list_filter(l.held, lambda x: x.n = v.target)[1].c AS goes FROM visits v JOIN brokered l ON v.server = l.server AND v.k = l.k + 1))"""


def connections(events):
    """Connections and requests of servers with five nodes each."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(e % 6 < 2, "up").when(e % 6 == 2, "down").when(e % 6 == 3, "malformed").otherwise("request")
    conn = F.floor(F.when(e % 6 == 2, e + 300).otherwise(e) / 1000)
    return events.select(F.floor(u / 5).alias("group"), e.alias("id"), e.alias("at"), u.alias("key"), kind.alias("kind"), conn.alias("conn"), (F.floor(u / 5) * 5 + e % 5).alias("target"))


@query("SELECT id, server, node, outcome, other, len(held)::BIGINT AS size FROM brokered WHERE k > 0", BROKER)
def signal_broker(spark, d):
    """Connections of a server with three places, what replaces and what is refused, and the requests over them."""
    out = folds.folded(connections(t.table(spark, d, "events")), folds.Broker(PLACES))
    return out.select("id", F.col("group").alias("server"), F.col("key").alias("node"), "outcome", "other", "size")


NODE = sql_base32("sha256(s_name)")


def _node(name):
    return columns.base32(F.unhex(F.sha2(name.cast("binary"), 256)))


@query(f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 < 2 THEN {NODE} END AS founder, s_suppkey % 4 < 2 AS valid FROM supplier")
def group_founders(spark, d):
    """Founders named by group ids: what follows the first dot, if it is a node id."""
    s = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), _node(F.col("s_name")).alias("node"))
    n = F.col("id") % 4
    group = F.when(n == 0, F.concat(F.lit("g."), "node")).when(n == 1, F.concat(F.lit("."), "node")).when(n == 2, F.concat(F.lit("g.x."), "node")).otherwise(F.concat(F.lit("g"), "node"))
    founder = members.founder(group)
    return s.select("id", founder.alias("founder"), F.coalesce(members.valid_node(founder), F.lit(False)).alias("valid"))


@query("SELECT n_name AS share_id, 'v' || n_regionkey AS verifier, n_nationkey % 2 = 0 AS holder FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey = n_nationkey % 5")
def verifier_match(spark, d):
    """Offers answered: with a verifier that is ours, never with an empty one."""
    n, k, r = t.table(spark, d, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    offers = n.select(F.col("n_name").alias("share_id"), F.when(k % 3 != 0, F.concat(F.lit("v"), r)).otherwise("").alias("verifier"))
    held = n.select(F.col("n_name").alias("share_id"), F.when(k % 3 != 0, F.concat(F.lit("v"), k % 5)).otherwise("").alias("verifier"), (k % 2 == 0).alias("holder"))
    return members.responsive(offers, held)


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN abs(event_id * 37 % 20000 - 10000) >= 5000 END AS skewed FROM events")
def clock_skew(spark, d):
    e = F.col("event_id")
    sent = F.when(e % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.lit(1_000_000) + e * 37 % 20_000)
    return t.table(spark, d, "events").select("event_id", members.skewed(sent, F.lit(1_010_000).cast("bigint")).alias("skewed"))


@query("SELECT s_nationkey AS network_id, s_suppkey AS node_id, s_suppkey * 7 % 300 AS role, s_suppkey // 2 AS added_by, s_suppkey * 10 AS added_at_ms FROM supplier WHERE s_suppkey * 7 % 300 <= 255")
def roster_wire(spark, d):
    k = F.col("s_suppkey")
    return members.wire_entries(t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("network_id"), k.alias("node_id"), (k * 7 % 300).alias("role"), F.floor(k / 2).alias("added_by"), (k * 10).alias("added_at_ms")))


@query("SELECT n_regionkey AS peer_id, string_agg(n_name || '=v' || n_nationkey, ',' ORDER BY n_name) AS verifiers, string_agg(n_name || '=' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END, ',' ORDER BY n_name) AS holders FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY 1")
def advert_maps(spark, d):
    """What peers offer, by folder; an offer without a folder id is left out."""
    k = F.col("n_nationkey")
    folders = t.table(spark, d, "nation").select(F.col("n_regionkey").alias("peer_id"), F.when(k % 7 != 0, F.col("n_name")).otherwise("").alias("folder_id"), F.concat(F.lit("v"), k).alias("verifier"), (k % 2 == 0).alias("holder"))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return members.adverts(folders).select("peer_id", text("verifiers").alias("verifiers"), text("holders").alias("holders"))


@query(f"""SELECT node_id, CASE WHEN k % 3 = 0 THEN '10.0.0.' || k % 250 ELSE '[fe80::' || k % 250 || ']' END || ':' || (4000 + k) AS addr FROM (SELECT s_suppkey AS k, {NODE} AS node_id FROM supplier) WHERE k % 5 <> 0 AND k % 3 <> 2 AND k <> 1""")
def browse_peers(spark, d):
    """Peers on the local network: others with a proper id and an address, IPv4 first."""
    k = F.col("k")
    s = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), _node(F.col("s_name")).alias("node"))
    none = F.array().cast("array<string>")
    v6 = F.array(F.concat(F.lit("fe80::"), k % 250))
    seen = s.select(F.when(k % 5 == 0, "not a node").otherwise(F.when(k == 1, "me").otherwise(F.col("node"))).alias("node_id"), F.when(k % 3 == 0, F.array(F.concat(F.lit("10.0.0."), k % 250))).otherwise(none).alias("ipv4"), F.when(k % 3 == 2, none).otherwise(v6).alias("ipv6"), (k + 4000).alias("port"))
    return members.browsed(seen, "me")


@query("SELECT 'u' || user_id AS folder, count(*) AS served FROM events WHERE event_type = 'view' GROUP BY user_id")
def served_counters(spark, d):
    """Rows served, by folder; ``streaming.streams.counted`` observes the same while a job runs."""
    e = t.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("u"), F.col("user_id")).alias("folder"))
    return network.metrics(e, "folder").withColumnRenamed("requests", "served")
