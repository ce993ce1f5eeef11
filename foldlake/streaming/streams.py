"""Streaming forms of the operators: keyed tables from change streams, bursts, rate limits, telemetry.

Each uses the transformation of the batch form.  Event times are the rows' own; the watermark is the caller's choice, since
late rows are otherwise settled by version vectors and not by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foldlake.operators import control, folds, state, sync, vectors
from foldlake.operators.network import clamp_ttl, telemetry_capped


class VersionedTable:
    """A table that a stream rewrites: one folder ``v<batch>`` for each batch, the highest complete one counts.

    A batch that runs again reads what was there before it and overwrites its own folder, so its effect happens once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def versions(self) -> list[int]:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found)

    def read(self, before: int | None = None) -> DataFrame:
        there = [v for v in self.versions() if before is None or v < before]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{there[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def fed_by(self, stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
        """Run ``merge(current, batch)`` for every batch of what is there now."""

        def step(batch: DataFrame, number: int) -> None:
            self.write(merge(self.read(before=number), batch), number)

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DeltaTable:
    """Rows of a replica and the cursor of the peer they came from, written as one: a version counts once both are there.

    A consumer that restarts goes on from the cursor of the last complete version; a page that does not move the cursor on
    is refused, and a page of another epoch starts from nothing known.
    """

    CURSOR = "folder string, peer_id string, epoch long, high_water long"

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.rows, self.cursors = VersionedTable(spark, f"{path.rstrip('/')}/rows", schema), VersionedTable(spark, f"{path.rstrip('/')}/cursors", self.CURSOR)

    def version(self) -> int:
        """The last version whose cursor, which is written after the rows, is complete."""
        return max(self.cursors.versions(), default=-1)

    def read(self) -> DataFrame:
        return self.rows.read(before=self.version() + 1)

    def cursor(self, folder: str, peer: str) -> tuple[int, int] | None:
        found = self.cursors.read().where((F.col("folder") == folder) & (F.col("peer_id") == peer)).select("epoch", "high_water").first()
        return tuple(found) if found else None

    def apply(self, batch: DataFrame, folder: str, peer: str, epoch: int, high_water: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Apply a page; says whether it did (a page that was applied before does nothing)."""
        at = self.cursor(folder, peer)
        if at is not None and at[0] == epoch and high_water <= at[1]:
            return False
        n = self.version() + 1
        spark = self.rows.spark
        moved = spark.createDataFrame([(folder, peer, epoch, high_water, 0)], self.CURSOR + ", at long")
        self.rows.write(merge(self.read(), batch), n)
        self.cursors.write(sync.advanced(self.cursors.read(), moved), n)
        return True


def latest_rows(key: str, order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge by which the row of the highest ``order`` per key stays: manifests, receipts, announcements, addresses."""
    return lambda current, batch: state.latest(current.unionByName(batch.select(*current.columns)), key, order)


def delta_rows(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge of remote versions: resolved against the rows before the batch, then put in their paths' places.

    A batch holds the latest version of each path and author; a copy's path is its own.
    """
    fresh = vectors.resolve(current, batch).drop("action")
    one = fresh.groupBy("path").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "path"]), F.struct("authored_ms", "author")).alias("_r")).select("path", "_r.*").select(*current.columns)
    return current.join(one.select("path"), "path", "left_anti").select(*current.columns).unionByName(one)


def registry_rows(now: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Announcements by node; expired ones are swept when a batch arrives."""

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        return latest_rows("node_id", "at")(current, batch).where(F.col("at") + clamp_ttl(F.col("ttl")) > now)

    return merge


def coalesced_rows(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Announcements (``folder, root, high_water, at``): the last of each folder counts, whatever came while the batch before ran."""
    last = sync.coalesced(batch, F.lit(0)).select("folder", "root", "high_water")
    return current.join(last.select("folder"), "folder", "left_anti").unionByName(last)


def capped_rows(cap_bytes: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Telemetry (``id, fields``) until the stored size reaches a cap; what comes after is rejected."""

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        held = current.agg(F.coalesce(F.sum(F.octet_length("fields")), F.lit(0))).first()[0]
        return current.unionByName(telemetry_capped(batch.select(*current.columns), cap_bytes - held))

    return merge


def presence_rows(capacity: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Live connections (``node_id, address, at``) after events (``up`` too): a node's new connection replaces its old one.

    New nodes are let in while there is room, in order of time; replacing needs no room.
    """

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        last = state.latest(batch.select("node_id", "address", "at", "up"), "node_id", "at")
        stay = current.join(last.select("node_id"), "node_id", "left_anti")
        known = last.where("up").join(current.select("node_id"), "node_id", "left_semi")
        room = capacity - stay.count() - known.count()
        new = last.where("up").join(current.select("node_id"), "node_id", "left_anti").orderBy("at", "node_id").limit(max(room, 0))
        return stay.unionByName(known.unionByName(new).select(*current.columns))

    return merge


def scheduled(spark: SparkSession, every: str, job: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Run a job by a processing-time trigger: rescans, tombstone sweeps, announcements, roster exchange.

    The stream only keeps time; a run that takes longer than the period is followed by one run, not by all that were missed.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, number: job(number)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def counted(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows`` that are counted on their way by the job that reads them, without a job of their own."""
    seen = Observation(name)
    return rows.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


class ControlLoop(StatefulProcessor):
    """Scans, snapshots and rescans of a folder as its events come: ``operators.control.requests`` by timers."""

    def __init__(self, debounce_ms: int, quiesce_ms: int, path_type: str):
        self.debounce_ms, self.quiesce_ms, self.path_type = debounce_ms, quiesce_ms, path_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dirty = handle.getMapState("dirty", f"path {self.path_type}", "at long")
        # last event, whether its snapshot is still to come, next rescan and the time between two
        self.clock = handle.getValueState("clock", "last long, open boolean, rescan long, every long")

    def due(self, folder, clock: tuple, dirty: dict, now: int) -> tuple[tuple, list[tuple]]:
        """What has to be asked for up to a time, in order of time."""
        last, open_, rescan, every = clock
        out = []
        if dirty and last + self.debounce_ms <= now:
            out += [(folder, last + self.debounce_ms, "scan", p) for p in dirty]
            dirty.clear()
        if open_ and last + self.quiesce_ms <= now:
            out.append((folder, last + self.quiesce_ms, "snapshot", None))
            open_ = False
        while rescan <= now:
            out.append((folder, rescan, "rescan", None))
            rescan += every
        return (last, open_, rescan, every), out

    def keep(self, clock: tuple, before: set, dirty: dict) -> None:
        for p in before - dirty.keys():
            self.dirty.removeKey((p,))
        for p in dirty.keys() - before:
            self.dirty.updateValue((p,), (dirty[p],))
        self.clock.update(clock)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        last, open_, rescan, _ = clock
        for at in {rescan, *([last + self.debounce_ms] if dirty else []), *([last + self.quiesce_ms] if open_ else [])}:
            self.handle.registerTimer(at)

    def run(self, folder, events: list[tuple], until: int | None) -> Iterator[pd.DataFrame]:
        clock = tuple(self.clock.get()) if self.clock.exists() else None
        dirty = {tuple(p)[0]: tuple(e)[0] for p, e in self.dirty.iterator()}
        before, out = set(dirty), []
        for at, path, every in events:
            if clock:
                clock, more = self.due(folder, clock, dirty, at)
                out += more
            clock = (at, True, clock[2], clock[3]) if clock else (at, True, at + every, every)
            dirty[path] = at
        if until is not None:
            clock, more = self.due(folder, clock, dirty, until)
            out += more
        self.keep(clock, before, dirty)
        if out:
            yield folds.framed(["folder", "at", "kind", "path"], out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat([*rows]).sort_values("at", kind="stable")
        return self.run(key[0], list(zip(own["at"].tolist(), own["path"].tolist(), own["every_ms"].tolist())), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.run(key[0], [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def requests(events: DataFrame, watermark: str, debounce_ms: int = 500, quiesce_ms: int = 2000, period_ms: int = 300_000, jitter_ms: int = 30_000) -> DataFrame:
    """``folder, at, kind, path`` of a stream of events (``folder, path, at`` in milliseconds), each once the watermark has passed its time."""
    kind = events.schema["path"].dataType.simpleString()
    timed = events.select("folder", "path", "at", control.step(F.col("folder"), period_ms, jitter_ms).alias("every_ms"), F.timestamp_millis("at").alias("_at")).withWatermark("_at", watermark)
    schema = f"folder {events.schema['folder'].dataType.simpleString()}, at long, kind string, path {kind}"
    return timed.groupBy("folder").transformWithStateInPandas(ControlLoop(debounce_ms, quiesce_ms, kind), schema, "Append", "EventTime")


def token_bucket(events: DataFrame, rps: float, burst: float) -> DataFrame:
    """``allowed`` of every event (``id, key, at_ms``); each key's tokens and last time are its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = held.get if held.exists else (float(burst), None)
        own = pd.concat(list(frames)).sort_values(["at_ms", "id"])
        allowed = []
        for at in own["at_ms"]:
            at = int(at)
            tokens = min(burst, tokens + (at - (at if last is None else last)) / 1000 * rps)
            last = at
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        held.update((float(tokens), last))
        yield own.assign(allowed=allowed)[["id", "key", "at_ms", "allowed"]]

    return events.select("id", "key", "at_ms").groupBy("key").applyInPandasWithState(step, "id long, key long, at_ms long, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


class FoldProcessor(StatefulProcessor):
    """A fold of ``operators.folds`` over a stream: entries are map state, so their number is bounded by the fold; sweeps are timers.

    A sweep that no event follows happens as soon as the watermark has passed its time.
    """

    def __init__(self, fold, key_type: str, columns: list[str]):
        self.fold, self.key_type, self.columns = fold, key_type, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", f"key {self.key_type}", self.fold.entry)

    def held(self) -> dict:
        found = {tuple(k)[0]: tuple(e) for k, e in self.entries.iterator()}
        return dict(sorted(found.items(), key=lambda x: x[1][1:]))

    def keep(self, before: dict, held: dict, now: int) -> None:
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, e in held.items():
            if before.get(k) != e:
                self.entries.updateValue((k,), e)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer((now // self.fold.sweep + 1) * self.fold.sweep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat([*rows]).sort_values(["at", "id"])
        before = self.held()
        held = dict(before)
        events = zip(*(own[c].tolist() for c in self.columns))
        out = [(key[0], *r) for r in folds.run(self.fold, held, events, 0)]
        self.keep(before, held, int(own["at"].iloc[-1]))
        yield folds.framed(["group", "id", "at", "key", *(c.split(" ")[0] for c in self.fold.output.split(", "))], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, before = expiredTimerInfo.getExpiryTimeInMs(), self.held()
        self.keep(before, self.fold.swept(before, now), now)
        return iter(())

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold, watermark: str = "0 seconds") -> DataFrame:
    """Results of ``fold`` for a stream of events; needs the RocksDB state store, as all ``transformWithState`` does."""
    own = folds.selected(events, fold)
    kind, columns = events.schema["key"].dataType.simpleString(), own.columns[1:]
    timed = own.withColumn("_at", F.timestamp_millis("at")).withWatermark("_at", watermark)
    return timed.groupBy("group").transformWithStateInPandas(FoldProcessor(fold, kind, columns), folds.schema(events, fold), "Append", "EventTime")


def telemetry(lines: DataFrame, known: Column, version: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of a JSON line stream (``value, node_id``, columns to keep) with the outcome of each; the sender's id never comes from the body."""
    body = F.from_json("value", "install_id string, schema_version int, event_millis long, fields string")
    rows = lines.select(*keep, "node_id", known.alias("_known"), body.alias("b"))
    outcome = F.when(~F.col("_known"), "denied").when(F.col("b.install_id").isNull() | F.col("b.fields").isNull(), "bad request").when(F.col("b.schema_version") != version, "bad version").otherwise("ok")
    return rows.select(*keep, "node_id", "b.*", outcome.alias("outcome"))
