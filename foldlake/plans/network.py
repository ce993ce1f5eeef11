"""Queries over the discovery side: addresses, registry, gates, rates, telemetry, bursts."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import functions as F

from foldlake.functions import columns
from foldlake.operators import control, folds, network, sync
from foldlake.plans.relations import query, sql_base32
from foldlake.session import settled, shared_dir
from foldlake.sources import tables as t
from foldlake.sources import trees
from foldlake.streaming.ingest import TelemetryStore

FIRST, SECOND = (10, 127, 169, 172, 192, 100, 8, 224, 0, 300), (0, 16, 64, 168, 254, 31)
KINDS = ("lan", "public", "stun", "lan", "other")
#: IPv6 texts by number: around ``x`` (hexadecimal), and what they are.
SIX = (
    ("2001:db8::", "", "public"), ("2001:0DB8:0:0:", ":0:0:1", "public"), ("fd00:0:", "::7", "private"), ("fc01:", "::", "private"), ("fe80::", "", "special"), ("fe80::", "%eth0", "special"), ("ff02::", "", "special"),
    ("::", "", "public"), ("64:ff9b::", ":8.8.4.4", "public"), ("", "::1::2", "bad"), ("1:2:3:4:5:6:7:", ":9", "bad"), ("g", "::", "bad"), ("1:2:3:4:5:6:", "::", "public"), ("1:2:3:4:5:6:7:", "::", "bad"),
    (":", "::2", "bad"), ("2001:db8::", "%", "bad"), ("1:2:3:4:5:6:", ":1.2.3.300", "bad"), ("1", "0000::", "bad"), ("fd00:0:", ":1:2:3:4:5", "private"), ("::FFFF:10.0.0.", "f", "bad"),
)
ADDRESSES = f"""octets AS (
  SELECT c_custkey AS id, {list(FIRST)}[c_custkey % 10 + 1] AS a, {list(SECOND)}[c_custkey // 10 % 6 + 1] AS b, c_custkey % 256 AS c, c_custkey * 3 % 256 AS d, c_custkey * 37 % 66000 AS port,
    {list(KINDS)}[c_custkey % 5 + 1] AS kind, c_custkey % 3 AS family, c_custkey // 3 % {len(SIX)} + 1 AS t, c_custkey % 24 + 256 AS x FROM customer),
texts AS (SELECT *, a || '.' || b || '.' || c || '.' || d AS four, {[x[0] for x in SIX]}[t] || printf('%x', x::BIGINT) || {[x[1] for x in SIX]}[t] AS six, {[x[2] for x in SIX]}[t] AS what FROM octets),
fours AS (SELECT *, ((a * 256::BIGINT + b) * 256 + c) * 256 + d AS n, a > 255 AS bad4, a = 127 OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239 OR (a = 0 AND b = 0 AND c = 0 AND d = 0) AS special4,
  a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) AS private4, a = 100 AND b BETWEEN 64 AND 127 AS cgnat4 FROM texts),
subnets AS (SELECT 167772160 + n_nationkey * 524288 AS lo, 167772160 + n_nationkey * 524288 + (1 << (14 + n_nationkey % 6)) - 1 AS hi FROM nation),
addresses AS (
  SELECT id, port, kind, CASE family WHEN 0 THEN four WHEN 1 THEN six ELSE '::ffff:' || four END AS ip, CASE WHEN family = 1 THEN what = 'bad' ELSE bad4 END AS bad, CASE WHEN family = 1 THEN what = 'special' ELSE special4 END AS special,
    CASE WHEN family = 1 THEN what = 'private' ELSE private4 END AS private, family <> 1 AND cgnat4 AS cgnat,
    CASE WHEN family = 1 THEN what = 'private' AND t <> 4 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey + 256 = x) ELSE EXISTS (SELECT 1 FROM subnets WHERE n BETWEEN lo AND hi) END AS here FROM fours)"""


def _addresses(spark, d):
    """IPv4, IPv6 and IPv4 within IPv6."""
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    four = F.concat_ws(".", pick(FIRST, k % 10), pick(SECOND, F.floor(k / 10) % 6), k % 256, k * 3 % 256)
    which = F.floor(k / 3) % len(SIX)
    six = F.concat(pick([x[0] for x in SIX], which), F.lower(F.hex(k % 24 + 256)), pick([x[1] for x in SIX], which))
    ip = F.when(k % 3 == 0, four).when(k % 3 == 1, six).otherwise(F.concat(F.lit("::ffff:"), four))
    return t.table(spark, d, "customer").select(k.alias("id"), ip.alias("ip"), (k * 37 % 66000).alias("port"), pick(KINDS, k % 5).alias("kind"))


@query("""SELECT id, CASE WHEN bad THEN 'bad ip' WHEN special THEN 'non-routable' WHEN port NOT BETWEEN 1 AND 65535 THEN 'bad port' WHEN kind = 'other' THEN 'bad type' ELSE 'ok' END AS state,
  NOT bad AND NOT special AND NOT private AS routable, CASE WHEN NOT bad AND (private OR cgnat) THEN 'lan' ELSE 'public' END AS type FROM addresses""", ADDRESSES)  # fmt: skip
def address_validate(spark, d):
    n = F.col("_n")
    return network.numbered_ip(_addresses(spark, d)).select("id", network.address_state(n, F.col("port"), F.col("kind")).alias("state"), network.routable(n).alias("routable"), network.address_type(n).alias("type"))


@query("SELECT id, CASE WHEN bad THEN 'bad' WHEN special THEN 'unroutable' WHEN private THEN 'private' ELSE 'public' END AS class FROM addresses", ADDRESSES)
def address_class(spark, d):
    return network.numbered_ip(_addresses(spark, d)).select("id", network.ip_class(F.col("_n")).alias("class"))


@query("SELECT id, ip FROM addresses WHERE NOT bad AND NOT special AND (NOT private OR here)", ADDRESSES)
def dialable_range_join(spark, d):
    return network.dialable(_addresses(spark, d).select("id", "ip"), _subnets(spark, d))


def _subnets(spark, d):
    """IPv4 networks of several lengths, and IPv6 ones of 48 bits with one of 64 inside of each."""
    k, low = F.col("n_nationkey"), F.col("n_nationkey") * 524288
    octet = lambda shift: F.shiftright(low, shift) % 256
    four = F.struct(F.concat_ws(".", F.lit(10), octet(16), octet(8), F.lit(0)).alias("net"), (18 - k % 6).alias("bits"))
    six = lambda bits: F.struct(F.concat(F.lit("fd00:0:"), F.lower(F.hex(k + 256)), F.lit("::")).alias("net"), F.lit(bits).alias("bits"))
    nets = F.when(k % 5 == 0, F.array(four, six(48), six(64))).otherwise(F.array(four))
    return t.table(spark, d, "nation").select(F.explode(nets).alias("s")).select("s.net", "s.bits")


VALID = "NOT bad AND NOT special AND port BETWEEN 1 AND 65535 AND kind <> 'other'"


@query(f"SELECT id, id % 4 AS place, ip, port, kind FROM addresses WHERE {VALID} AND kind <> 'stun' AND (NOT private OR here)", ADDRESSES)
def dial_candidates(spark, d):
    return network.dial_candidates(_addresses(spark, d).withColumn("place", F.col("id") % 4).select("id", "place", "ip", "port", "kind"), _subnets(spark, d))


@query(f"SELECT id, ip, port, kind, NOT private AS routable FROM addresses WHERE {VALID}", ADDRESSES)
def candidate_filters(spark, d):
    return network.candidates(_addresses(spark, d))


@query(f"""SELECT id, CASE WHEN id % 6 = 0 THEN 'h' || id || ':' || (4000 + id) END AS host, CASE WHEN id % 6 = 0 THEN {sql_base32("h")} END AS pin FROM (SELECT c_custkey AS id, sha256(c_name) AS h FROM customer)""")
def server_urls(spark, d):
    """Server addresses with a pinned node; five of six are of another scheme, without a port, with a path, a user or a broken pin."""
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), columns.base32(F.unhex(F.sha2(F.col("c_name").cast("binary"), 256))).alias("pin"))
    host = F.concat(F.lit("h"), "id", F.lit(":"), F.col("id") + 4000)
    shape = F.element_at(F.array(
        F.concat(F.lit("fold://"), host, F.lit("?id="), "pin"), F.concat(F.lit("http://"), host, F.lit("?id="), "pin"), F.concat(F.lit("fold://h?id="), "pin"),
        F.concat(F.lit("fold://"), host, F.lit("/x?id="), "pin"), F.concat(F.lit("fold://me@"), host, F.lit("?id="), "pin"), F.concat(F.lit("fold://"), host, F.lit("?id=1"), "pin"),
    ), (F.col("id") % 6 + 1).cast("int"))
    return c.select("id", network.server_url(shape, "fold").alias("u")).select("id", "u.host", "u.pin")


ANNOUNCES = """announces AS (SELECT event_id AS id, user_id AS node_id, event_id * 30 AS "at", event_id * 97 % 5000 - 100 AS ttl, 'a' || event_id AS address FROM events)"""


def _announces(spark, d):
    e = F.col("event_id")
    return t.table(spark, d, "events").select(e.alias("id"), F.col("user_id").alias("node_id"), (e * 30).alias("at"), (e * 97 % 5000 - 100).alias("ttl"), F.concat(F.lit("a"), e).alias("address"))


@query("""SELECT node_id, "at", ttl, address, "at" + CASE WHEN ttl <= 0 THEN 600 ELSE least(greatest(ttl, 60), 3600) END AS expires_at
FROM (SELECT * FROM announces QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY "at" DESC) = 1) WHERE expires_at > (SELECT max("at") - 900 FROM announces)""", ANNOUNCES)  # fmt: skip
def registry_live(spark, d):
    a = _announces(spark, d)
    return network.registry(a.drop("id"), a.agg(F.max("at") - 900))


@query("""SELECT node_id, expires_at FROM (
  SELECT node_id, "at" + CASE WHEN ttl <= 0 THEN 600 ELSE least(greatest(ttl, 60), 3600) END AS expires_at FROM announces QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY "at" DESC) = 1) WHERE expires_at > 20000""", ANNOUNCES)
def registry_swept(spark, d):
    entries = network.registry(_announces(spark, d).drop("id"), 0)
    return network.swept(entries.select("node_id", "expires_at"), 20_000)


CAPACITY, SWEEP = 4, 900
SERVED = f"""visits AS (SELECT *, node_id % 20 AS server, id % 5 = 1 AS lookup, CASE WHEN ttl <= 0 THEN 600 ELSE least(greatest(ttl, 60), 3600) END AS lasts, row_number() OVER (PARTITION BY node_id % 20 ORDER BY "at", id) AS k FROM announces),
served AS (
  SELECT server, 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS node_id, '' AS outcome, []::STRUCT(n BIGINT, e BIGINT)[] AS held FROM (SELECT DISTINCT server FROM visits)
  UNION ALL
  SELECT server, k, id, node_id, CASE WHEN lookup THEN CASE WHEN fresh THEN 'found' ELSE 'absent' END WHEN there THEN 'refreshed' WHEN len(swept) >= {CAPACITY} THEN 'full' ELSE 'new' END,
    CASE WHEN lookup AND fresh OR NOT lookup AND NOT there AND len(swept) >= {CAPACITY} THEN swept WHEN lookup THEN list_filter(swept, lambda x: x.n <> node_id) ELSE list_filter(swept, lambda x: x.n <> node_id) || [{{'n': node_id, 'e': "at" + lasts}}] END
  FROM (SELECT *, len(list_filter(swept, lambda x: x.n = node_id)) > 0 AS there, len(list_filter(swept, lambda x: x.n = node_id AND x.e > "at")) > 0 AS fresh
    FROM (SELECT v.*, list_filter(s.held, lambda x: x.e > v."at" // {SWEEP} * {SWEEP}) AS swept FROM visits v JOIN served s ON v.server = s.server AND v.k = s.k + 1)))"""


def visits(announces):
    """Announcements and lookups of twenty servers (milliseconds)."""
    return announces.select((F.col("node_id") % 20).alias("group"), "id", (F.col("at") * 1000).alias("at"), F.col("node_id").alias("key"), (F.col("id") % 5 == 1).alias("lookup"), (network.clamp_ttl(F.col("ttl")) * 1000).alias("ttl"))


@query("SELECT id, server, node_id, outcome, len(held)::BIGINT AS size FROM served WHERE k > 0", f"{ANNOUNCES}, {SERVED}")
def registry_capped(spark, d):
    """A place comes free when a sweep or a lookup finds its node expired."""
    out = folds.folded(visits(_announces(spark, d)), folds.Registry(CAPACITY, SWEEP * 1000))
    return out.select("id", F.col("group").alias("server"), F.col("key").alias("node_id"), "outcome", "size")


RPS, BURST, IDLE_MS = 1 / 86_400, 5.0, 8 * 3_600_000


def _buckets(idle: str) -> str:
    """The fold over each key's events as a recursive relation."""
    full = f"least({BURST}::DOUBLE, CASE WHEN {idle} THEN {BURST}::DOUBLE ELSE b.tokens END + (r.at_ms - CASE WHEN {idle} THEN r.at_ms ELSE b.at_ms END)::DOUBLE / 1000 * {RPS!r}::DOUBLE)"
    return f"""requests AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
buckets AS (
  SELECT id, key, at_ms, n, {BURST}::DOUBLE - 1 AS tokens, true AS allowed FROM requests WHERE n = 1
  UNION ALL
  SELECT id, key, at_ms, n, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (SELECT r.*, {full} AS have FROM requests r JOIN buckets b ON r.key = b.key AND r.n = b.n + 1))"""


def _requests(spark, d):
    return t.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


@query("SELECT id, key, at_ms, allowed FROM buckets", _buckets("false"))
def rate_limit_outcomes(spark, d):
    return network.token_bucket(_requests(spark, d), RPS, BURST)


@query("SELECT id, key, at_ms, allowed FROM buckets", _buckets(f"r.at_ms - b.at_ms > {IDLE_MS}"))
def rate_limit_idle(spark, d):
    """The same with keys that are forgotten after eight hours without a request."""
    return network.token_bucket(_requests(spark, d), RPS, BURST, idle_ms=IDLE_MS)


GATES, KEYS, TICK_MS = 10, 6, 3_600_000
LIMITED = f"""asked AS (SELECT event_id AS id, user_id AS key, user_id % {GATES} AS gate, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id % {GATES} ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
limited AS (
  SELECT gate, 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS key, true AS allowed, NULL::BIGINT AS evicted, []::STRUCT(n BIGINT, t DOUBLE, l BIGINT)[] AS held FROM (SELECT DISTINCT gate FROM asked)
  UNION ALL
  SELECT gate, k, id, key, have >= 1, CASE WHEN full_ THEN others[1].n END, CASE WHEN full_ THEN others[2:] ELSE others END || [{{'n': key, 't': CASE WHEN have >= 1 THEN have - 1 ELSE have END, 'l': at_ms}}]
  FROM (SELECT *, len(others) >= {KEYS} AS full_, CASE WHEN len(own) = 0 THEN {BURST}::DOUBLE ELSE least({BURST}::DOUBLE, own[1].t + (at_ms - own[1].l)::DOUBLE / 1000 * {RPS!r}::DOUBLE) END AS have
    FROM (SELECT *, list_filter(swept, lambda x: x.n <> key) AS others, list_filter(swept, lambda x: x.n = key) AS own
      FROM (SELECT a.*, list_filter(l.held, lambda x: x.l >= a.at_ms // {TICK_MS} * {TICK_MS} - {IDLE_MS}) AS swept FROM asked a JOIN limited l ON a.gate = l.gate AND a.k = l.k + 1))))"""


def asked(requests):
    """Requests at ten gates."""
    return requests.select((F.col("key") % GATES).alias("group"), "id", F.col("at_ms").alias("at"), "key")


LIMITER = folds.Limiter(RPS, BURST, KEYS, IDLE_MS, TICK_MS)


@query("SELECT id, gate, key, allowed, evicted, len(held)::BIGINT AS size FROM limited WHERE k > 0", LIMITED)
def rate_limit_bounded(spark, d):
    """Gates that hold six keys each: a new one takes the place of the key that was quiet for longest."""
    out = folds.folded(asked(_requests(spark, d)), LIMITER)
    return out.select("id", F.col("group").alias("gate"), "key", "allowed", "evicted", "size")


@query("""SELECT b.id, b.key, CASE WHEN f.n IS NULL OR b.n < f.n THEN 'ok' WHEN b.n = f.n THEN 'closes' ELSE 'lost' END AS state
FROM buckets b LEFT JOIN (SELECT key, min(n) AS n FROM buckets WHERE NOT allowed GROUP BY key) f USING (key)""", _buckets("false"))  # fmt: skip
def message_limits(spark, d):
    """A connection that exceeds its rate is closed, and what comes after is lost."""
    return network.closed_connections(network.token_bucket(_requests(spark, d), RPS, BURST))


GATE = """gate AS (SELECT event_id AS id, user_id AS node_id, event_type, CASE WHEN user_id % 50 IN (3, 7) THEN 'denied' WHEN event_id % 17 = 0 THEN 'filtered' WHEN event_id % 5 = 0 THEN 'rate_limited'
  WHEN user_id IN (11, 13) THEN 'denied' WHEN event_id % 7 = 0 THEN 'rate_limited' ELSE 'ok' END AS outcome FROM events)"""


def _gate(spark, d):
    e = F.col("event_id")
    requests = t.table(spark, d, "events").select(e.alias("id"), (F.col("user_id") % 50).alias("ip"), F.col("user_id").alias("node_id"), "event_type")
    ips, nodes = spark.createDataFrame([(3,), (7,)], "ip long"), spark.createDataFrame([(11,), (13,)], "node_id long")
    return network.gate(requests, ips, F.col("id") % 17 == 0, F.col("id") % 5 == 0, nodes, F.col("id") % 7 == 0)


@query("SELECT id, node_id, outcome FROM gate", GATE)
def gate_outcomes(spark, d):
    return _gate(spark, d).select("id", "node_id", "outcome")


@query("SELECT event_type, outcome, count(*) AS requests FROM gate GROUP BY ALL", GATE)
def metrics_by_label(spark, d):
    return network.metrics(_gate(spark, d), "event_type", "outcome")


@query("SELECT event_type AS kind, count(*) AS records, count(json_extract(props, '$.k')) AS with_field, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def telemetry_by_field(spark, d):
    return network.telemetry(t.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("fields")), "k")


@query("SELECT id FROM (SELECT event_id AS id, sum(strlen(props)) OVER (ORDER BY event_id) AS s FROM events) WHERE s <= 20000")
def telemetry_capped(spark, d):
    return network.telemetry_capped(t.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("fields")), 20_000).select("id")


DISK = 3000


@query(f"""SELECT id, CASE WHEN judged <> 'ok' THEN judged WHEN before >= {DISK} THEN 'full' ELSE 'ok' END AS outcome, CASE WHEN judged = 'ok' AND before < {DISK} THEN fields END AS fields FROM (
  SELECT *, coalesce(sum(CASE WHEN judged = 'ok' THEN strlen(fields) ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT event_id AS id, props AS fields, CASE WHEN user_id % 5 = 3 THEN 'denied' WHEN event_id % 9 = 4 OR props IS NULL THEN 'bad request' WHEN event_id % 10 = 3 THEN 'bad version' ELSE 'ok' END AS judged FROM events))""")
def telemetry_ingested(spark, d):
    """Lines that come as a stream, in two runs of it: the outcome of each, and what is stored until the cap is reached."""
    root = f"{shared_dir(spark)}/foldlake-{uuid.uuid4().hex}"
    e = F.col("event_id")
    body = F.to_json(F.struct(F.concat(F.lit("i"), "user_id").alias("install_id"), F.when(e % 10 == 3, 2).otherwise(1).alias("schema_version"), e.alias("event_millis"), F.col("props").alias("fields")))
    lines = t.table(spark, d, "events").select(e.alias("id"), F.col("user_id").alias("node_id"), F.when(e % 9 == 4, "{").otherwise(body).alias("value"))
    half = (lines.agg(F.max("id")).first()[0] or 0) // 2
    store = TelemetryStore(spark, f"{root}/store", DISK, lambda: F.col("node_id") % 5 != 3)
    for part in (lines.where(F.col("id") <= half), lines.where(F.col("id") > half)):
        part.write.mode("append").parquet(f"{root}/lines")
        store.fed_by(spark.readStream.schema(lines.schema).parquet(f"{root}/lines"), f"{root}/checkpoint").awaitTermination()
    out = settled(store.outcomes().join(store.records().select("id", "fields"), "id", "left"))
    shutil.rmtree(trees.local(root))
    return out


@query("""SELECT peer, "at", CAST(CASE WHEN ok THEN 0 ELSE least(pow(2, least(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY peer, island ORDER BY "at"), 30) - 1), 60) END AS BIGINT) AS wait
FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY peer ORDER BY "at") AS island FROM attempts)""",
"""attempts AS (SELECT user_id AS peer, event_id AS "at", event_type = 'purchase' AS ok FROM events)""")  # fmt: skip
def dial_backoff(spark, d):
    return network.backoff(t.table(spark, d, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("ok"))).select("peer", "at", "wait")


@query("SELECT peer, address FROM (SELECT user_id AS peer, 'a' || event_id % 9 AS address, event_type <> 'error' AS ok FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE ok")
def last_working_address(spark, d):
    e = t.table(spark, d, "events")
    return network.last_working(e.select(F.col("user_id").alias("peer"), F.concat(F.lit("a"), F.col("event_id") % 9).alias("address"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("at")))


@query("""SELECT folder, epoch_us(min(ts)) // 1000 AS start_ms, count(DISTINCT user_id) AS paths, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY ts) AS burst FROM (
    SELECT event_id % 2 AS folder, ts, user_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_id % 2 ORDER BY ts)) < 600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY folder, burst""")  # fmt: skip
def debounce_batches(spark, d):
    e = t.table(spark, d, "events").select((F.col("event_id") % 2).alias("folder"), F.col("user_id").alias("path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return control.bursts(e, 600_000).select("folder", "start_ms", "paths", "events")


@query("""SELECT chunk_no, first(peer ORDER BY tried) FILTER (ok) AS peer, coalesce(min(tried) FILTER (ok), max(tried)) AS attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY (i - chunk_no % n + n) % n + CASE WHEN peer = 2 THEN 1000000 ELSE 0 END) AS tried FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY peer) - 1 AS i, count(*) OVER (PARTITION BY chunk_no) AS n FROM (
      SELECT DISTINCT event_id % 300 AS chunk_no, user_id % 5 AS peer, (event_id % 300 + user_id % 5) % 3 = 0 AS ok FROM events))) GROUP BY chunk_no""")  # fmt: skip
def pull_order(spark, d):
    chunk, peer = F.col("event_id") % 300, F.col("user_id") % 5
    sources = t.table(spark, d, "events").select(chunk.alias("chunk_no"), peer.alias("peer"), (peer == 2).alias("announcer"), ((chunk + peer) % 3 == 0).alias("ok")).distinct()
    return network.pull_order(sources)


PAGE, ROW, REF = 1024, 96, 40
#: Greedy paging as a recursive relation: each version opens a page, joins it, or is sliced over pages of its own.
PAGED = f"""sized AS (SELECT split_part(path, '/', 1) AS folder, seq, CASE WHEN c = 10 THEN 60 ELSE c END AS chunks, {ROW} + {REF} * CASE WHEN c = 10 THEN 60 ELSE c END AS need,
  row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY seq) AS n FROM feed),
step AS (SELECT greatest(1, ({PAGE} - {ROW}) // {REF}) AS k),
paged AS (
  SELECT folder, seq, chunks, need, n, 0::BIGINT AS page, need > {PAGE} AS big, CASE WHEN need > {PAGE} THEN 0 ELSE need END AS used, CASE WHEN need > {PAGE} THEN (chunks + k - 1) // k ELSE 0 END AS next FROM sized, step WHERE n = 1
  UNION ALL
  SELECT s.folder, s.seq, s.chunks, s.need, s.n, CASE WHEN p.used = 0 THEN p.next WHEN p.used + s.need > {PAGE} THEN p.page + 1 ELSE p.page END AS page, s.need > {PAGE},
    CASE WHEN s.need > {PAGE} THEN 0 WHEN p.used = 0 OR p.used + s.need > {PAGE} THEN s.need ELSE p.used + s.need END,
    CASE WHEN s.need > {PAGE} THEN CASE WHEN p.used = 0 THEN p.next WHEN p.used + s.need > {PAGE} THEN p.page + 1 ELSE p.page END + (s.chunks + k - 1) // k ELSE 0 END
  FROM sized s JOIN paged p ON s.folder = p.folder AND s.n = p.n + 1, step),
pages AS (
  SELECT folder, page, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows, 0::BIGINT AS chunk_from, sum(chunks)::BIGINT AS chunk_to FROM paged WHERE NOT big GROUP BY folder, page
  UNION ALL SELECT folder, page + i, seq, seq, 1, i * k, least(chunks, (i + 1) * k) FROM paged, step, range(8) r(i) WHERE big AND i * k < chunks)"""


def _pages(spark, d):
    folder, chunks = F.split_part("path", F.lit("/"), F.lit(1)), F.when(F.col("c") == 10, 60).otherwise(F.col("c"))
    feed = t.feed(spark, d).select(folder.alias("folder"), "seq", chunks.alias("chunks"))
    return feed, network.delta_pages(feed, PAGE, ROW, REF)


@query("SELECT folder, page, first_seq, last_seq, rows, chunk_from, chunk_to FROM pages", PAGED)
def delta_pages(spark, d):
    return _pages(spark, d)[1]


@query("""SELECT folder, page, CASE WHEN page >= 12 THEN 'too many pages' WHEN lag((last_seq, chunk_to)) OVER (PARTITION BY folder ORDER BY page) >= (last_seq, chunk_to) THEN 'stalled' ELSE 'ok' END AS state
FROM (SELECT folder, page, CASE WHEN page % 5 = 4 THEN 0 ELSE last_seq END AS last_seq, chunk_to FROM pages)""", PAGED)  # fmt: skip
def page_progress(spark, d):
    """A consumer's view of the pages, some of which do not move on."""
    broken = _pages(spark, d)[1].withColumn("last_seq", F.when(F.col("page") % 5 == 4, 0).otherwise(F.col("last_seq")))
    return sync.page_states(broken, 12)


@query("SELECT folder, seq, chunks AS received, true AS complete FROM paged WHERE big", PAGED)
def pages_assembled(spark, d):
    """Versions that came in slices, put together again."""
    feed, pages = _pages(spark, d)
    return sync.assembled(pages, feed.where(F.lit(ROW) + F.col("chunks") * REF > PAGE))
