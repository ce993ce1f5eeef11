"""Addresses, registries, gates, rate limits, telemetry: the discovery side in batch form."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.functions.expressions import let

OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"
TYPES = ("lan", "public", "stun")
#: Address ranges by name (fixed values of the address registries); prefixes of IPv4 count within its 32 bits.
RANGES = {
    "unspecified": (("0.0.0.0", 32), ("::", 128)),
    "loopback": (("127.0.0.0", 8), ("::1", 128)),
    "link_local": (("169.254.0.0", 16), ("fe80::", 10)),
    "multicast": (("224.0.0.0", 4), ("ff00::", 8)),
    "private": (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("fc00::", 7)),
    "cgnat": (("100.64.0.0", 10),),
}
SPECIAL = ("loopback", "unspecified", "link_local", "multicast")


def ip_number(ip: Column) -> Column:
    """An address of either family as ``hi`` and ``lo`` of its 128 bits, null if the text is none; IPv4 is as ``::ffff:a.b.c.d``.

    IPv6 may have one ``::``, which stands for one group at least, an IPv4 address as its last two groups, and a zone.
    """
    number = F.aggregate(F.transform(F.split(ip, r"\."), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda t, x: t * 256 + x)
    mapped = F.when(ip.rlike(rf"^{IPV4}$"), F.struct(F.lit(0).cast("long").alias("hi"), (number + F.lit(0xFFFF << 32)).alias("lo")))
    none = F.array().cast("array<string>")
    groups_of = lambda half: F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":"))

    def in_groups(bare: Column) -> Column:
        """The last two groups as such where an IPv4 address stands for them."""
        tail = F.regexp_extract(bare, rf":({IPV4})$", 1)
        pair = let(F.transform(F.split(tail, r"\."), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), lambda h: F.concat(h[0], h[1], F.lit(":"), h[2], h[3]))
        return F.when(tail != "", F.concat(F.left(bare, F.char_length(bare) - F.char_length(tail)), pair)).otherwise(bare)

    def number_of(halves: Column, left: Column, right: Column) -> Column:
        named = F.size(left) + F.size(right)
        counts = F.when(F.size(halves) == 2, named <= 7).otherwise((F.size(halves) == 1) & (named == 8))
        proper = counts & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        digits = F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), 8 - named), right), lambda g: F.lpad(g, 4, "0")), "")
        half = lambda d, at: F.conv(F.substring(d, at, 16), 16, -10).cast("long")
        return F.when(proper, let(digits, lambda d: F.struct(half(d, 1).alias("hi"), half(d, 17).alias("lo"))))

    six = let(F.split(in_groups(F.regexp_replace(ip, "%.+$", "")), "::"), lambda h: let(F.struct(groups_of(F.get(h, F.lit(0))).alias("l"), groups_of(F.get(h, F.lit(1))).alias("r")), lambda s: number_of(h, s["l"], s["r"])))
    return F.coalesce(mapped, F.when(ip.contains(":"), six))


def numbered_ip(rows: DataFrame, ip: str = "ip") -> DataFrame:
    """``rows`` with the address's number as ``_n``, worked out once: the array keeps the optimizer from copying it into every test."""
    return rows.withColumn("_n", F.explode(F.array(ip_number(F.col(ip)))))


def prefix_bits(net: Column, bits: Column) -> Column:
    """Prefix length among 128 bits of a network whose text is of either family."""
    return F.when(net.contains(":"), bits).otherwise(bits + 96)


def masked(number: Column, bits: Column) -> Column:
    """The first ``bits`` of a number, the rest zero."""
    # a shift by 64 places is one by none, so whole and empty halves are told apart
    cut = lambda x, n: F.when(n >= 64, x).when(n <= 0, F.lit(0).cast("long")).otherwise(x.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int"))))
    return F.struct(cut(number["hi"], bits).alias("hi"), cut(number["lo"], bits - 64).alias("lo"))


def fixed_number(net: str) -> int:
    return (0xFFFF << 32) + int(ipaddress.IPv4Address(net)) if "." in net else int(ipaddress.IPv6Address(net))


def inside(number: Column, *names: str) -> Column:
    """Is an address in one of the named ranges?"""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = F.lit(False)
    for net, bits in (r for name in names for r in RANGES[name]):
        bits, at = bits + 96 * ("." in net), fixed_number(net)
        mask = ((1 << bits) - 1) << (128 - bits)
        for key, shift in (("hi", 64), ("lo", 0)):
            m, v = mask >> shift & (1 << 64) - 1, at >> shift & (1 << 64) - 1
            test = number[key].bitwiseAND(F.lit(signed(m))) == F.lit(signed(v)) if m else None
            both = test if key == "hi" else both if test is None else both & test
        out = out | both
    return out


def ip_class(n: Column) -> Column:
    """``bad``, ``unroutable``, ``private`` or ``public``."""
    return F.when(n.isNull(), "bad").when(inside(n, *SPECIAL), "unroutable").when(inside(n, "private"), "private").otherwise("public")


def address_state(n: Column, port: Column, kind: Column) -> Column:
    """``ok`` or the first rule an announced address (its number) breaks."""
    return (
        F.when(n.isNull(), "bad ip").when(inside(n, *SPECIAL), "non-routable")
        .when(~port.between(1, 65535), "bad port").when(~kind.isin(*TYPES), "bad type").otherwise("ok")
    )


def routable(n: Column) -> Column:
    return F.coalesce(n.isNotNull() & ~inside(n, *SPECIAL, "private"), F.lit(False))


def address_type(n: Column) -> Column:
    """``lan`` for private and carrier-grade addresses, else ``public``."""
    return F.when(inside(n, "private", "cgnat"), "lan").otherwise("public")


def dialable(addresses: DataFrame, subnets: DataFrame) -> DataFrame:
    """Addresses that are public, or private inside a local subnet (``net, bits`` of either family).

    Containment is an equality of prefixes: an address is cut to each prefix length that a subnet has, of which there are 129 at most.
    """
    a = numbered_ip(addresses)
    public = a.where(routable(F.col("_n")))
    nets = subnets.select(ip_number(F.col("net")).alias("_net"), prefix_bits(F.col("net"), F.col("bits")).cast("int").alias("_bits"))
    nets = nets.where("_net is not null").select("_bits", masked(F.col("_net"), F.col("_bits")).alias("_prefix")).distinct()
    lengths = F.broadcast(nets.agg(F.collect_set("_bits").alias("_lengths")))

    def cut(rows: DataFrame, number: str) -> DataFrame:
        """``rows`` once for each prefix length, with their prefix."""
        each = rows.join(lengths).withColumn("_bits", F.explode("_lengths"))
        return each.withColumn("_prefix", masked(F.col(number), F.col("_bits"))).drop("_lengths")

    # without subnets inside of others an address matches once
    wider = nets.select(F.col("_bits").alias("_own"), F.col("_prefix").alias("_number"))
    inner = cut(wider, "_number").where("_bits < _own").join(nets, ["_bits", "_prefix"], "left_semi").select(F.col("_own").alias("_bits"), F.col("_number").alias("_prefix"))
    local = cut(a.where(inside(F.col("_n"), "private")), "_n").join(nets.join(inner, ["_bits", "_prefix"], "left_anti"), ["_bits", "_prefix"], "left_semi")
    return public.drop("_n").unionByName(local.select(*addresses.columns))


def dial_candidates(addresses: DataFrame, subnets: DataFrame) -> DataFrame:
    """Addresses to dial after a lookup (``id, place, ip, port, kind``): valid, not from STUN and dialable; ``place`` keeps their order."""
    ok = numbered_ip(addresses).where((F.col("kind") != "stun") & (address_state(F.col("_n"), F.col("port"), F.col("kind")) == "ok")).drop("_n")
    return dialable(ok, subnets)


def candidates(addresses: DataFrame) -> DataFrame:
    """Candidates that are valid, and which of them can be reached from outside: ``id, ip, port, kind, routable``."""
    rows = numbered_ip(addresses)
    return rows.where(address_state(F.col("_n"), F.col("port"), F.col("kind")) == "ok").select("id", "ip", "port", "kind", routable(F.col("_n")).alias("routable"))


def server_url(url: Column, scheme: str) -> Column:
    """``host`` and ``pin`` of ``scheme://host:port?id=<node>``; null for anything else, also for a path or a user."""
    from foldlake.operators.members import NODE_ID

    node = NODE_ID.strip("^$")
    whole = rf"^{scheme}://([^/?#@:\[\]]+:[0-9]+|\[[0-9a-fA-F:.]+\]:[0-9]+)\?(?:[^#]*&)?id=({node})(?:&[^#]*)?(?:#.*)?$"
    return F.when(url.rlike(whole), F.struct(F.regexp_extract(url, whole, 1).alias("host"), F.regexp_extract(url, whole, 2).alias("pin")))


def clamp_ttl(ttl: Column, default: int = 600, low: int = 60, high: int = 3600) -> Column:
    return F.when(ttl <= 0, default).otherwise(F.least(F.greatest(ttl, F.lit(low)), F.lit(high)))


def registry(announces: DataFrame, now: int | Column | DataFrame) -> DataFrame:
    """Live registry: the last announcement of each node whose expiry lies after ``now`` (expired exactly at it).

    ``now`` is a number, or a table of one row and column that names it.
    """
    last = announces.groupBy("node_id").agg(F.max_by(F.struct("at", "ttl", "address"), "at").alias("_a")).select("node_id", "_a.*")
    last = last.withColumn("expires_at", F.col("at") + clamp_ttl(F.col("ttl")))
    if isinstance(now, DataFrame):
        clock = now.toDF("_now").limit(1)
        return last.join(F.broadcast(clock), F.col("expires_at") > F.col("_now")).drop("_now")
    return last.where(F.col("expires_at") > now)


def swept(entries: DataFrame, now: int) -> DataFrame:
    """What a sweep leaves of a registry (``node_id, expires_at``)."""
    return entries.where(F.col("expires_at") > now)


def token_bucket(events: DataFrame, rps: float, burst: float, key: str = "key", at: str = "at_ms", idle_ms: int | None = None) -> DataFrame:
    """``allowed`` of every event: a bucket of each key starts full, refills with time and gives a token an event.

    A fold in time order; events of a key stream through in sorted batches, so a hot key needs no more memory.  A key that was
    idle for longer than ``idle_ms`` has been swept and starts full again.
    """
    order = events.select("id", key, at)
    schema = order.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, burst, 0
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[key], pdf[at]):
                if k != now or (idle_ms is not None and t - last > idle_ms):
                    now, tokens, last = k, float(burst), t
                tokens = min(burst, tokens + (t - last) / 1000 * rps)
                last = t
                ok = tokens >= 1
                tokens -= ok
                allowed.append(ok)
            yield pdf.assign(allowed=allowed)

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", allowed boolean"
    return order.repartition(key).sortWithinPartitions(key, at, "id").mapInPandas(fold, out)


def closed_connections(outcomes: DataFrame) -> DataFrame:
    """``state`` of every message: allowed, the one that exceeded the rate and closed the connection, or lost after that."""
    first = outcomes.where(~F.col("allowed")).groupBy("key").agg(F.min(F.struct("at_ms", "id")).alias("_end"))
    both = outcomes.join(first, "key", "left")
    here = F.struct("at_ms", "id")
    return both.select("id", "key", F.when(F.col("_end").isNull() | (here < F.col("_end")), "ok").when(here == F.col("_end"), "closes").otherwise("lost").alias("state"))


def gate(requests: DataFrame, denied_ips: DataFrame, filtered: Column, limited: Column, denied_nodes: DataFrame, node_limited: Column) -> DataFrame:
    """Outcome of every request by the first gate that stops it."""
    ips, nodes = denied_ips.select("ip", F.lit(True).alias("_ip")), denied_nodes.select("node_id", F.lit(True).alias("_node"))
    hit = requests.join(ips, "ip", "left").join(nodes, "node_id", "left")
    outcome = F.when(F.col("_ip"), "denied").when(filtered, "filtered").when(limited, "rate_limited").when(F.col("_node"), "denied").when(node_limited, "rate_limited").otherwise("ok")
    return hit.select(*requests.columns, outcome.alias("outcome"))


def metrics(outcomes: DataFrame, *labels: str) -> DataFrame:
    return outcomes.groupBy(*labels).agg(F.count("*").alias("requests"))


def telemetry(records: DataFrame, field: str) -> DataFrame:
    """Count and sum of a numeric field of the open JSON ``fields``."""
    value = F.expr(f"try_variant_get(try_parse_json(fields), '$.{field}', 'double')")
    return records.select("kind", value.alias("_v")).groupBy("kind").agg(F.count("*").alias("records"), F.count("_v").alias("with_field"), F.sum(F.col("_v").cast("bigint")).alias("total"))


def telemetry_capped(records: DataFrame, cap_bytes: int, order: str = "id") -> DataFrame:
    """Records stored before the running size passes the cap, in insertion order.

    Sizes are summed by partition of a range first; only the sums of the partitions are put in one order.
    """
    from foldlake.operators.state import ranged

    sized, parts = ranged(records.withColumn("_size", F.octet_length("fields").cast("bigint")), [order])
    before = parts(F.sum("_size"))
    own = F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("_own", own).join(F.broadcast(before), "_part").where(F.col("_own") + F.col("_before") <= cap_bytes).select(*records.columns)


def backoff(attempts: DataFrame, first: int = 1, most: int = 60) -> DataFrame:
    """Seconds to wait after every attempt: doubles with each failure in a row, from ``first`` to ``most``; 0 on success."""
    order = Window.partitionBy("peer").orderBy("at")
    island = F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = attempts.withColumn("_g", island)
    k = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("peer", "_g").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("wait", F.when(F.col("ok"), 0).otherwise(F.least(F.lit(first) * F.pow(F.lit(2), F.least(k, F.lit(30)) - 1), F.lit(most)).cast("bigint"))).drop("_g")


def last_working(attempts: DataFrame) -> DataFrame:
    """Address cache: the address of each peer's last attempt, if it worked."""
    last = attempts.groupBy("peer").agg(F.max_by(F.struct("address", "ok"), "at").alias("_l"))
    return last.where("_l.ok").select("peer", F.col("_l.address").alias("address"))


def pull_order(sources: DataFrame) -> DataFrame:
    """Peer to ask for each chunk: holders rotate by chunk, the announcer last; a failed attempt goes on to the next.

    ``sources``: ``chunk_no, peer, announcer, ok``.  The result has ``peer`` (null if all fail) and ``attempts``.
    """
    per = Window.partitionBy("chunk_no")
    ranked = sources.withColumn("_i", F.row_number().over(per.orderBy("peer")) - 1).withColumn("_n", F.count("*").over(per))
    place = F.pmod(F.col("_i") - F.col("chunk_no"), F.col("_n")) + F.when(F.col("announcer"), 1_000_000).otherwise(0)
    tried = ranked.withColumn("_at", F.row_number().over(per.orderBy(place)))
    first = F.min(F.when(F.col("ok"), F.struct("_at", "peer")))
    return tried.groupBy("chunk_no").agg(first.alias("_f"), F.max("_at").alias("_all")).select("chunk_no", F.col("_f.peer").alias("peer"), F.coalesce("_f._at", "_all").cast("bigint").alias("attempts"))


def delta_pages(feed: DataFrame, budget: int, row_bytes: int, chunk_bytes: int) -> DataFrame:
    """Pages of a change feed under a byte budget; an oversize version is sliced over pages of its own.

    ``feed``: ``folder, seq, chunks``.  Pages: ``folder, page, first_seq, last_seq, rows, chunk_from, chunk_to``.  Greedy packing is a
    fold in sequence order; rows of a folder stream through in sorted batches.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, page, now, out = None, 0, None, []

        def close():
            nonlocal now, page
            if now:
                out.append((folder, page, *now[:3], 0, now[3]))
                page, now = page + 1, None

        for pdf in batches:
            for f, seq, n in zip(pdf["folder"], pdf["seq"], pdf["chunks"]):
                if f != folder:
                    close()
                    folder, page = f, 0
                need = row_bytes + n * chunk_bytes
                if now and now[4] + need > budget:
                    close()
                if need > budget:
                    step, done = max(1, (budget - row_bytes) // chunk_bytes), 0
                    while done < n:
                        upto = min(n, done + step)
                        out.append((f, page, seq, seq, 1, done, upto))
                        page, done = page + 1, upto
                else:
                    now = [seq, seq, 1, n, need] if not now else [now[0], seq, now[2] + 1, now[3] + n, now[4] + need]
            yield pd.DataFrame(out, columns=["folder", "page", "first_seq", "last_seq", "rows", "chunk_from", "chunk_to"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["folder", "page", "first_seq", "last_seq", "rows", "chunk_from", "chunk_to"])

    return feed.select("folder", "seq", "chunks").repartition("folder").sortWithinPartitions("folder", "seq").mapInPandas(fold, "folder string, page bigint, first_seq bigint, last_seq bigint, rows bigint, chunk_from bigint, chunk_to bigint")
