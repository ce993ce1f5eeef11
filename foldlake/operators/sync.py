"""Exchange between replicas: delta rows, cursors, pages, announcements, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.session import release, settled

MAX_PAGES = 1 << 20


def as_delta(manifests: DataFrame, manifest_chunks: DataFrame) -> DataFrame:
    """Local rows as a peer gets them: with their chunk list, and with a time of deletion only when deleted."""
    lists = manifest_chunks.groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "length"))).alias("chunks"))
    deleted_ms = F.when(F.col("deleted"), F.col("authored_ms"))
    none = F.array().cast("array<struct<ord:bigint,chunk_id:string,length:bigint>>")
    return manifests.join(lists, "manifest_id", "left").select("path", "manifest_id", "seq", "author", "authored_ms", "deleted", deleted_ms.alias("deleted_ms"), F.coalesce("chunks", none).alias("chunks"))


def decoded(delta: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Rows to apply, with their size, and the distinct chunks to pull (of live regular files only).

    A deletion without a time counts from now, so that it does not expire in the past.
    """
    size = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda t, c: t + c["length"])
    rows = delta.withColumn("size", size).withColumn("deleted_ms", F.when(F.col("deleted"), F.coalesce(F.nullif(F.col("deleted_ms"), F.lit(0)), F.lit(now_ms))))
    pull = delta.where(~F.col("deleted") & (F.col("kind") == "regular")).select(F.explode("chunks").alias("c")).select("c.chunk_id", "c.length").distinct()
    return rows, pull


def start(cursors: DataFrame, epoch: int) -> DataFrame:
    """Where the next delta of each peer begins: its cursor, or 0 when that is of another epoch."""
    return cursors.select("peer_id", F.when(F.col("epoch") == epoch, F.col("high_water")).otherwise(0).cast("bigint").alias("since"))


def advanced(cursors: DataFrame, batch: DataFrame) -> DataFrame:
    """Cursors (``folder, peer_id, epoch, high_water``) after a batch of them, of which the last (``at``) of a peer counts."""
    last = batch.groupBy("folder", "peer_id").agg(F.max_by(F.struct("epoch", "high_water"), "at").alias("_c")).select("folder", "peer_id", "_c.*")
    return cursors.join(last.select("folder", "peer_id"), ["folder", "peer_id"], "left_anti").unionByName(last)


def plan(announced: DataFrame, own_root: DataFrame, cursors: DataFrame) -> DataFrame:
    """What an announcement (``peer_id, root, epoch, high_water``) leads to: with equal roots at most the cursor moves, otherwise a pull.

    ``own_root`` is one row; the result has ``peer_id, action, since``.
    """
    known = cursors.select("peer_id", F.col("epoch").alias("_e"), F.col("high_water").alias("_h"))
    both = announced.join(known, "peer_id", "left").join(F.broadcast(own_root.select(F.col("root").alias("_root")).limit(1)))
    same = F.col("root") == F.col("_root")
    current = F.coalesce((F.col("_e") == F.col("epoch")) & (F.col("_h") == F.col("high_water")), F.lit(False))
    action = F.when(same & current, "nothing").when(same, "cursor").otherwise("pull")
    return both.select("peer_id", action.alias("action"), F.when(~same, F.when(F.col("_e") == F.col("epoch"), F.col("_h")).otherwise(0)).cast("bigint").alias("since"))


def page_states(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """``state`` of every page (``folder, page, last_seq, chunk_to``): the cursor must move on strictly, and pages are capped.

    The cursor after a page is its last sequence, and within a sliced version the chunks delivered.
    """
    order = Window.partitionBy("folder").orderBy("page")
    here = F.struct("last_seq", "chunk_to")
    state = F.when(F.col("page") >= most, "too many pages").when(F.lag(here).over(order) >= here, "stalled").otherwise("ok")
    return pages.select("folder", "page", state.alias("state"))


def assembled(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions that come in slices (``folder, seq, chunks``): chunks received, and whether that is all."""
    each = pages.withColumnRenamed("first_seq", "seq").join(versions, ["folder", "seq"])
    return each.groupBy("folder", "seq").agg(F.sum(F.col("chunk_to") - F.col("chunk_from")).alias("received"), F.max("chunks").alias("_all")).select("folder", "seq", "received", (F.col("received") == F.col("_all")).alias("complete"))


def coalesced(announcements: DataFrame, batch: Column) -> DataFrame:
    """Of the announcements that arrive while one is worked on, the last per folder counts."""
    return announcements.groupBy("folder", batch.alias("batch")).agg(F.max_by(F.struct("root", "high_water"), "at").alias("_a"), F.count("*").alias("announced")).select("folder", "batch", "_a.*", "announced")


def pushes(changes: DataFrame, takes_ms: int) -> DataFrame:
    """Runs of a push (``folder, run, start_ms``) that takes a time: changes during a run lead to one more run after it.

    ``changes``: ``folder, at_ms``.  A fold in time order; a folder's changes pass through in sorted batches.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder, run, begun, again = None, 0, None, False
        for pdf in batches:
            out = []
            for f, at in zip(pdf["folder"], pdf["at_ms"]):
                if f != folder:
                    if again:
                        out.append((folder, run, begun + takes_ms))
                    folder, run, begun, again = f, 0, None, False
                while begun is not None and again and at >= begun + takes_ms:
                    begun, again = begun + takes_ms, False
                    out.append((f, run, begun))
                    run += 1
                if begun is None or at >= begun + takes_ms:
                    begun = at
                    out.append((f, run, begun))
                    run += 1
                else:
                    again = True
            yield pd.DataFrame(out, columns=["folder", "run", "start_ms"])
        yield pd.DataFrame([(folder, run, begun + takes_ms)] if again else [], columns=["folder", "run", "start_ms"])

    return changes.select("folder", "at_ms").repartition("folder").sortWithinPartitions("folder", "at_ms").mapInPandas(fold, "folder string, run long, start_ms long")


def routed(requests: DataFrame, presence: DataFrame) -> DataFrame:
    """Outcome of requests (``id, at, from_id, to_id``) by who is connected then: ``presence`` has ``node_id, at, up, address``.

    The last event of the target at or before the request counts; a new connection replaces the one before.  A window over both
    sides of a node, so no pair of request and event is made.
    """
    event = presence.select(F.col("node_id").alias("_node"), "at", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("from_id"), F.struct("up", "address").alias("_e"))
    ask = requests.select(F.col("to_id").alias("_node"), "at", F.lit(1).alias("_kind"), "id", "from_id", F.lit(None).cast(event.schema["_e"].dataType).alias("_e"))
    last = F.last("_e", ignorenulls=True).over(Window.partitionBy("_node").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    seen = event.unionByName(ask).withColumn("_last", last).where("_kind = 1")
    ok = F.coalesce(F.col("_last.up"), F.lit(False)) & (F.col("from_id") != F.col("_node"))
    return seen.select("id", F.when(ok, "brokered").otherwise("unavailable").alias("outcome"), F.when(ok, F.col("_last.address")).alias("address"))


def gossip(held: DataFrame, links: DataFrame, cap: int = 4096, rounds: int = 1000) -> DataFrame:
    """Holdings (``node_id, entry``) once rounds of exchange bring nothing new.

    A round sends only what the round before brought, as neighbours have the rest, and writes only what is new.  A node above the cap
    stays above it, because what it lacks can only grow: it is left out from then on.
    """
    from foldlake.operators.members import lacking

    spark, parts = held.sparkSession, [settled(held.select("node_id", "entry").distinct())]
    for _ in range(rounds):
        known = spark.read.schema(parts[0].schema).parquet(*(p._foldlake_path for p in parts))
        come = lacking(parts[-1], known, links).select(F.col("peer").alias("node_id"), "entry")
        new = settled(come.select(*(F.col(f.name).cast(f.dataType) for f in parts[0].schema)))
        over = new.groupBy("node_id").agg(F.count("*").alias("_n")).where(F.col("_n") > cap).select("node_id")
        if not over.isEmpty():
            over = settled(over)
            links = settled(links.join(over.withColumnRenamed("node_id", "peer"), "peer", "left_anti"))
            all_, new = new, settled(new.join(over, "node_id", "left_anti"))
            release(all_)
        if new.isEmpty():
            return known
        parts.append(new)
    raise RuntimeError("gossip did not settle")
