"""Rosters, roles, offers and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.session import release, settled

READER, WRITER, HOLDER = 0, 1, 2
NODE_ID = r"^[a-z2-7]{52}$"


def closure(entries: DataFrame, founder: int) -> DataFrame:
    """Accepted roster entries (``node_id, added_by, role, depth``): the founder's own entry, then entries signed by an accepted writer, to the fixpoint.

    Only writers extend the frontier, and each node is accepted once: by the entry of the least depth, then of the smaller
    signer, then role.  Joins only, and all rounds that it takes:

    * nodes with one entry hang from each other like a forest; doubling pointers bring each to its ``above``, the nearest node that has
      several entries or is the founder, in as many rounds as the logarithm of the longest chain.  Circles never get there;
    * between the nodes with several entries, which are left, the least depth that is not settled yet is settled in each round.
    """
    entries = settled(entries.where("sig_ok").select("node_id", "added_by", "role"))
    own = (F.col("node_id") == founder) & (F.col("added_by") == founder) & (F.col("role") == WRITER)
    first = entries.where(own).distinct().withColumn("depth", F.lit(0).cast("long"))
    rest = settled(entries.where((F.col("node_id") != F.col("added_by")) & (F.col("node_id") != founder)).distinct())
    single = rest.groupBy("node_id").agg(F.count("*").alias("_n"), F.min("added_by").alias("added_by"), F.min("role").alias("role")).where("_n = 1")

    # above: where the pointer is; steps: how far; through: the nodes passed on the way are writers
    chain = settled(single.select("node_id", "added_by", "role", F.col("added_by").alias("above"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("through")))
    last = chain.count()
    rounds, reached = 0, -1
    while reached != last and 1 << max(rounds - 1, 0) <= last:
        up = chain.select(F.col("node_id").alias("above"), (F.col("through") & (F.col("role") == WRITER)).alias("_t"), F.col("above").alias("_a"), F.col("steps").alias("_s"))
        moved = chain.join(up, "above", "left").select(
            "node_id", "added_by", "role", F.coalesce("_a", "above").alias("above"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), (F.col("through") & F.coalesce("_t", F.lit(True))).alias("through"),
        )
        before, chain = chain, settled(moved)
        release(before)
        rounds, reached = rounds + 1, chain.join(chain.select(F.col("node_id").alias("above")), "above", "left_anti").count()
    ended = chain.join(chain.select(F.col("node_id").alias("above")), "above", "left_anti")

    # entries of the other nodes, from where their signer's chain begins
    others = rest.join(single.select("node_id"), "node_id", "left_anti")
    via = ended.select(F.col("node_id").alias("added_by"), F.col("above").alias("_a"), F.col("steps").alias("_s"), (F.col("through") & (F.col("role") == WRITER)).alias("_t"))
    straight = others.join(single.select(F.col("node_id").alias("added_by")), "added_by", "left_anti").select("node_id", "added_by", "role", F.col("added_by").alias("above"), F.lit(1).cast("long").alias("steps"))
    open_ = settled(straight.unionByName(others.join(via, "added_by").where("_t").select("node_id", "added_by", "role", F.col("_a").alias("above"), (F.col("_s") + 1).alias("steps"))))
    parts, offers = [settled(first)], None
    fresh = parts[0]
    while True:
        writers = fresh.where(F.col("role") == WRITER).select(F.col("node_id").alias("above"), "depth")
        new = open_.join(writers, "above").select("node_id", "added_by", "role", (F.col("depth") + F.col("steps")).alias("depth"))
        new = new if offers is None else new.unionByName(offers)
        # what is offered to nodes that are not settled yet
        now = settled(_unsettled(new, parts))
        if offers is not None:
            release(offers)
        offers, least = now, now.agg(F.min("depth")).first()[0]
        if least is None:
            break
        best = offers.where(F.col("depth") == least).groupBy("node_id").agg(F.min(F.struct("added_by", "role")).alias("_e"))
        fresh = settled(best.select("node_id", "_e.added_by", "_e.role", F.lit(least).cast("long").alias("depth")))
        parts.append(fresh)
    anchors = _union(parts)
    writers = anchors.where(F.col("role") == WRITER).select(F.col("node_id").alias("above"), "depth")
    hung = ended.where("through").join(writers, "above").select("node_id", "added_by", "role", (F.col("depth") + F.col("steps")).alias("depth"))
    return anchors.unionByName(hung).withColumn("depth", F.col("depth").cast("int"))


def _union(parts: list[DataFrame]) -> DataFrame:
    """One read of all parts' tables."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p._foldlake_path for p in parts])


def _unsettled(offers: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return offers.join(_union(parts).select("node_id"), "node_id", "left_anti")


def founder(group: Column) -> Column:
    """Founder of a group id: what follows the first dot, if it is a node id."""
    tail = F.regexp_extract(group, r"^[^.]*\.(.*)$", 1)
    return F.when(tail.rlike(NODE_ID), tail)


def valid_node(node: Column) -> Column:
    return node.rlike(NODE_ID)


def effective_roles(nodes: DataFrame, accepted: DataFrame, founder_node) -> DataFrame:
    """Role of every node in the group: the founder writes even without an entry, strangers have none."""
    role = F.when(F.col("node_id") == founder_node, F.lit(WRITER)).otherwise(F.col("role"))
    return nodes.select("node_id").join(accepted.select("node_id", "role"), "node_id", "left").select("node_id", role.alias("role"))


def writer_authored(versions: DataFrame, roles: DataFrame) -> DataFrame:
    """Versions by current writers; an author without a known role is dropped."""
    return versions.join(roles.where(F.col("role") == WRITER).select(F.col("node_id").alias("author")), "author", "left_semi")


def may_receive_key(pairs: DataFrame, roles: DataFrame) -> DataFrame:
    """``self, peer, deliver``: keys go from writers to readers and writers, never to holders or strangers."""
    one = roles.select(F.col("node_id").alias("self"), F.col("role").alias("_s"))
    two = roles.select(F.col("node_id").alias("peer"), F.col("role").alias("_p"))
    deliver = (F.col("_s") == WRITER) & F.col("_p").isin(READER, WRITER)
    return pairs.join(one, "self", "left").join(two, "peer", "left").select("self", "peer", F.coalesce(deliver, F.lit(False)).alias("deliver"))


def key_outcome(known: Column, holder: Column, sender_role: Column, length: Column, verifier_ok: Column, present: Column) -> Column:
    """What becomes of a received key, tested in this order; a key that is there is never replaced."""
    return (
        F.when(~known, "unknown folder").when(holder, "holder folder").when(F.coalesce(sender_role != WRITER, F.lit(True)), "not a writer")
        .when(length != 32, "bad length").when(F.coalesce(~verifier_ok, F.lit(False)), "verifier mismatch").when(present, "already set").otherwise("stored")
    )


def intersect_offers(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Folders both sides offer: ``folder_id, state`` shared, or mismatched when both announce different verifiers."""
    a, b = mine.select("folder_id", F.col("verifier").alias("_a")), theirs.select("folder_id", F.col("verifier").alias("_b"))
    differ = (F.length("_a") > 0) & (F.length("_b") > 0) & (F.col("_a") != F.col("_b"))
    return a.join(b, "folder_id").select("folder_id", F.when(differ, "mismatched").otherwise("shared").alias("state"))


def offered(granted: DataFrame, local: DataFrame) -> DataFrame:
    """Folders granted to a peer that exist here under a non-empty id."""
    return granted.where(F.length("folder_id") > 0).join(local.select("folder_id"), "folder_id", "left_semi")


def co_members(groups: DataFrame, me) -> DataFrame:
    """Distinct members of all groups that ``me`` is in, without ``me``, in order."""
    mine = groups.where(F.col("node_id") == me).select("network_id")
    return groups.join(mine, "network_id", "left_semi").where(F.col("node_id") != me).select("node_id").distinct().orderBy("node_id")


def authorized(groups: DataFrame, entries: DataFrame, peer) -> DataFrame:
    """Groups (``network_id, founder_id``) that a peer founded or is a member of."""
    member = entries.where(F.col("node_id") == peer).select("network_id", F.lit(True).alias("_m"))
    return groups.join(member, "network_id", "left").where((F.col("founder_id") == peer) | F.coalesce("_m", F.lit(False))).select("network_id")


def first_writer_wins(roster: DataFrame, entries: DataFrame) -> DataFrame:
    """Add-only insert: entries for nodes that are not in the roster yet, the first of each."""
    new = entries.join(roster.select("node_id"), "node_id", "left_anti")
    return roster.unionByName(new.groupBy("node_id").agg(F.min_by(F.struct(*[c for c in roster.columns if c != "node_id"]), "added_at_ms").alias("_e")).select("node_id", "_e.*").select(*roster.columns))


def latest_receipts(events: DataFrame) -> DataFrame:
    """Upsert of receipts: the last per peer and direction."""
    return events.groupBy("peer_id", "direction").agg(F.max_by(F.struct("epoch", "high_water", "at"), "at").alias("_r")).select("peer_id", "direction", "_r.*")


def sane_receipts(receipts: DataFrame, epoch: int, high_water: int) -> DataFrame:
    """Receipts of this epoch, capped at what was ever sent."""
    return receipts.where(F.col("epoch") == epoch).withColumn("high_water", F.least("high_water", F.lit(high_water)))


def converged_high_water(members: DataFrame, receipts: DataFrame, epoch: int) -> DataFrame:
    """``gated, high_water``: least acknowledged sequence over all members; 0 while one is missing or at another epoch.

    Without members there is no gate and the high-water mark is null.
    """
    both = members.select("peer_id").join(receipts, "peer_id", "left")
    behind = F.bool_or(F.coalesce(F.col("epoch") != epoch, F.lit(True)))
    return both.agg(F.count("*").alias("_n"), behind.alias("_b"), F.min("high_water").alias("_h")).select((F.col("_n") > 0).alias("gated"), F.when(F.col("_n") > 0, F.when(F.col("_b"), 0).otherwise(F.col("_h"))).alias("high_water"))


def one_session(sessions: DataFrame) -> DataFrame:
    """Of several sessions with a peer keep the one whose initiator has the smaller node id (then the earliest)."""
    own = Window.partitionBy("peer_id").orderBy(F.least("self_id", "peer_id") != F.col("initiator_id"), "at")
    return sessions.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def gossip_round(held: DataFrame, links: DataFrame, cap: int = 4096) -> DataFrame:
    """What each node sends a neighbour: entries that it has and the neighbour lacks; nothing above the cap.

    ``held``: ``node_id, entry``; ``links``: ``node_id, peer``.
    """
    new = lacking(held, held, links)
    few = new.groupBy("peer").agg(F.count("*").alias("_n")).where(F.col("_n") <= cap).select("peer")
    return new.join(few, "peer", "left_semi")


def lacking(sent: DataFrame, held: DataFrame, links: DataFrame) -> DataFrame:
    """Entries (``peer, entry``) of ``sent`` (``node_id, entry``) that reach a neighbour who does not hold them."""
    come = links.join(sent, "node_id").select("peer", "entry").distinct()
    return come.join(held.select(F.col("node_id").alias("peer"), "entry"), ["peer", "entry"], "left_anti")


def responsive(offers: DataFrame, held: DataFrame) -> DataFrame:
    """Offered folders (``share_id, verifier``) whose verifier is ours (``share_id, verifier, holder``); an empty one never matches."""
    mine = held.select("share_id", F.col("verifier").alias("_v"), "holder")
    both = offers.where(F.length("verifier") > 0).join(mine, "share_id")
    return both.where(F.col("verifier") == F.col("_v")).select("share_id", "verifier", "holder")


def wire_entries(entries: DataFrame) -> DataFrame:
    """Roster entries off the wire: a role that does not fit a byte is no entry."""
    return entries.where(F.col("role") <= 255).select("network_id", "node_id", "role", "added_by", "added_at_ms")


def adverts(folders: DataFrame) -> DataFrame:
    """Per peer, what it offers by folder id: ``verifiers`` and ``holders`` as maps; a folder without an id is left out."""
    named = folders.where(F.length("folder_id") > 0)
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_set(F.struct("folder_id", c))))
    return named.groupBy("peer_id").agg(as_map("verifier").alias("verifiers"), as_map("holder").alias("holders"))


def browsed(entries: DataFrame, me: str) -> DataFrame:
    """Peers seen on the local network (``node_id, ipv4, ipv6, port``): others with a proper id and an address, IPv4 first."""
    host = F.coalesce(F.get(F.filter("ipv4", lambda x: x.isNotNull()), F.lit(0)), F.get(F.filter("ipv6", lambda x: x.isNotNull()), F.lit(0)))
    at = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return entries.where((F.col("node_id") != me) & valid_node(F.col("node_id")) & host.isNotNull()).select("node_id", F.concat(at, F.lit(":"), F.col("port").cast("string")).alias("addr"))


def skewed(sent_ms: Column, now_ms: Column, limit_ms: int = 5000) -> Column:
    """Is a peer's clock off?  Null where it sent no time."""
    return F.when(sent_ms != 0, F.abs(now_ms - sent_ms) >= limit_ms)
