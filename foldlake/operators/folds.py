"""Folds over events in order, with entries by key that are bounded in number: the registry and the
broker of a server, the limiter of a gate.

A fold holds a dictionary of entries for each group (a server, a gate) and gives every event a result.  ``folded`` runs it over a table: groups
stream through sorted partitions, memory is that of one group's entries.  ``streams.folded`` runs the same steps over a stream, with the
entries as map state and the sweeps as timers.

Events have ``group, id, at`` (milliseconds), ``key`` and the fold's further columns; of one time the smaller id comes first.  A sweep happens at
every multiple of ``sweep``, before the events of that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Registry:
    """Announcements and lookups of a server that takes ``capacity`` nodes; entries: ``expires``.

    A node that is there, expired or not, is refreshed; a new one is taken while there is room.  An expired entry keeps its place until
    a sweep or a lookup of it.  ``outcome``: new, refreshed or full; found or absent.  ``size``: entries after the event.
    """

    capacity: int
    sweep: int
    columns = ("lookup boolean", "ttl long")
    entry = "expires long"
    output = "outcome string, size long"

    def swept(self, held: dict, at: int) -> dict:
        return {k: e for k, e in held.items() if e[0] > at}

    def step(self, held: dict, event: int, at: int, key: object, lookup: bool, ttl: int) -> tuple:
        if lookup:
            found = key in held and held[key][0] > at
            if not found:
                held.pop(key, None)
            outcome = "found" if found else "absent"
        elif key not in held and len(held) >= self.capacity:
            outcome = "full"
        else:
            outcome = "refreshed" if key in held else "new"
            held[key] = (at + ttl,)
        return outcome, len(held)


@dataclass(frozen=True)
class Limiter:
    """Token buckets of a gate that holds ``capacity`` keys; entries: ``tokens``, time and id of the last request, in order of these.

    A bucket starts full, refills with time and gives a token a request.  A new key takes the place of the one whose last request is the
    longest ago if there is no room; a sweep forgets keys without a request for ``idle``.  A key that comes back starts full again.  ``evicted``
    is the key that had to go, ``size`` the keys that are held after the event.
    """

    rps: float
    burst: float
    capacity: int
    idle: int
    sweep: int
    columns = ()
    entry = "tokens double, last long, event long"
    output = "allowed boolean, evicted long, size long"

    def swept(self, held: dict, at: int) -> dict:
        return {k: e for k, e in held.items() if e[1] >= at - self.idle}

    def step(self, held: dict, event: int, at: int, key: object) -> tuple:
        evicted = None
        tokens, last, _ = held.pop(key, (float(self.burst), at, 0))
        if len(held) >= self.capacity:
            evicted = next(iter(held))
            del held[evicted]
        tokens = min(self.burst, tokens + (at - last) / 1000 * self.rps)
        allowed = tokens >= 1
        held[key] = (tokens - allowed, at, event)  # the last in order
        return bool(allowed), evicted, len(held)


@dataclass(frozen=True)
class Broker:
    """Connections of a server that holds ``capacity`` nodes, and the requests that it brokers between them; entries: ``conn``, the live one.

    ``kind`` of an event: up, down, request or malformed.  A node that is connected replaces its connection even if there is no room; a
    new one is refused then.  The end of a connection that was replaced changes nothing.  A request comes over its node's live connection and needs
    one of its target, which is another node; a malformed message is answered with an error, and the connection stays.  ``outcome``:
    connected, replaced or refused; closed or stale; brokered, unavailable or not connected; bad request.  ``other`` is the connection that was replaced
    or that a request goes to, ``size`` the number of connections after the event.
    """

    capacity: int
    sweep: int = 31_536_000_000
    columns = ("kind string", "conn long", "target long")
    entry = "conn long, since long"
    output = "outcome string, other long, size long"

    def swept(self, held: dict, at: int) -> dict:
        return held

    def step(self, held: dict, event: int, at: int, key: object, kind: str, conn: int, target: int) -> tuple:
        own, other = held.get(key), None
        if kind == "up":
            if own is None and len(held) >= self.capacity:
                outcome = "refused"
            else:
                outcome, other = ("connected", None) if own is None else ("replaced", own[0])
                held[key] = (conn, at)
        elif own is None or own[0] != conn:
            outcome = "stale" if kind == "down" else "not connected"
        elif kind == "down":
            del held[key]
            outcome = "closed"
        elif kind == "malformed":
            outcome = "bad request"
        elif target == key or target not in held:
            outcome = "unavailable"
        else:
            outcome, other = "brokered", held[target][0]
        return outcome, other, len(held)


def run(fold, held: dict, events: Iterator[tuple], tick: int) -> Iterator[tuple]:
    """Results of a group's events; ``held`` ends as the entries that are left, ``tick`` is the time of the last sweep."""
    for event, at, key, *more in events:
        now = at // fold.sweep * fold.sweep
        if now > tick:
            left, tick = fold.swept(held, now), now
            if len(left) < len(held):
                held.clear()
                held.update(left)
        yield event, at, key, *fold.step(held, event, at, key, *more)


def schema(events: DataFrame, fold) -> str:
    """Schema of the result: group, id, at and key of the events, then the fold's output."""
    return ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in ("group", "id", "at", "key")) + ", " + fold.output


def selected(events: DataFrame, fold) -> DataFrame:
    return events.select("group", "id", "at", "key", *(c.split(" ")[0] for c in fold.columns))


def framed(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    """Rows as a frame; columns with nulls stay objects, so that whole numbers stay whole."""
    return pd.DataFrame({c: pd.Series(v, dtype=object if any(x is None for x in v) else None) for c, v in zip(names, zip(*rows))}, columns=names)


def folded(events: DataFrame, fold) -> DataFrame:
    names = ["group", "id", "at", "key", *(c.split(" ")[0] for c in fold.output.split(", "))]

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, tick, first = None, {}, 0, True
        for pdf in frames:
            rows = []
            for g, own in pdf.groupby("group", sort=False):
                if first or g != group:
                    group, held, tick, first = g, {}, 0, False
                events_ = zip(*(own[c].tolist() for c in own.columns[1:]))
                rows += [(g, *r) for r in run(fold, held, events_, tick)]
                tick = int(own["at"].iloc[-1]) // fold.sweep * fold.sweep
            if rows:
                yield framed(names, rows)

    return selected(events, fold).repartition("group").sortWithinPartitions("group", "at", "id").mapInPandas(part, schema(events, fold))
