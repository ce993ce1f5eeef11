"""Streams that have read everything equal the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from foldlake.operators import control, folds, network, state, vectors
from foldlake.plans.exchange import connections
from foldlake.sources import tables
from foldlake.streaming import streams


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The feed in four files, in sequence order, as the batches of a stream."""
    path = str(tmp_path_factory.mktemp("feed"))
    f = tables.feed(spark, sf).drop("ts").withColumn("at", F.timestamp_millis("authored_ms"))
    for k in range(4):
        f.where((F.floor((F.col("seq") - 1) / 250)) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, parts):
    return spark.readStream.schema(spark.read.parquet(parts).schema).option("maxFilesPerTrigger", 1).parquet(parts)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def appended(df, tmp_path):
    df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


def test_latest_rows(spark, parts, tmp_path):
    columns = ["path", "seq", "manifest_id", "deleted"]
    table = streams.VersionedTable(spark, str(tmp_path / "t"), "path string, seq long, manifest_id string, deleted boolean")
    for _ in range(2):  # the second start has nothing new
        table.fed_by(stream(spark, parts).select(*columns), streams.latest_rows("path", "seq"), str(tmp_path / "c")).awaitTermination()
    assert len(table.versions()) == 4
    assert rows(table.read()) == rows(state.latest(spark.read.parquet(parts).select(*columns)))


def test_token_bucket(spark, parts, tmp_path):
    pick = lambda df: df.select(F.col("seq").alias("id"), (F.col("seq") % 10).alias("key"), F.col("authored_ms").alias("at_ms"))
    got = appended(streams.token_bucket(pick(stream(spark, parts)), 1 / 43_200, 3.0), tmp_path)
    assert rows(got) == rows(network.token_bucket(pick(spark.read.parquet(parts)), 1 / 43_200, 3.0))
    assert got.select("allowed").distinct().count() == 2


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["registry", "limiter"])
def test_folds_of_streams_equal_tables(spark, parts, rocks, tmp_path, name):
    """The same outcome for every event, and no more entries than the fold may hold."""
    base = lambda df: df.select((F.hash("path") % 3).alias("group"), F.col("seq").alias("id"), F.col("authored_ms").alias("at"), F.abs(F.hash("path") % 40).cast("long").alias("key"), (F.col("seq") % 5 == 0).alias("lookup"), (F.col("seq") % 90 * 3_600_000).alias("ttl"))
    fold = folds.Registry(7, 20 * 3_600_000) if name == "registry" else folds.Limiter(1 / 43_200, 2.0, 7, 40 * 3_600_000, 10 * 3_600_000)
    got, want = appended(streams.folded(base(stream(spark, parts)), fold), tmp_path), folds.folded(base(spark.read.parquet(parts)), fold)
    assert rows(got) == rows(want)
    assert got.agg(F.max("size")).first()[0] == 7
    assert got.select("outcome" if name == "registry" else "allowed").distinct().count() == (5 if name == "registry" else 2)
    if name == "limiter":
        assert got.where("evicted is not null").count() > 10


def test_a_broker_of_a_stream_equals_that_of_a_table(spark, parts, rocks, tmp_path):
    pick = lambda df: connections(df.select(F.col("seq").alias("event_id"), (F.col("seq") * 7 % 23).alias("user_id")))
    got, want = appended(streams.folded(pick(stream(spark, parts)), folds.Broker(3)), tmp_path), folds.folded(pick(spark.read.parquet(parts)), folds.Broker(3))
    assert rows(got) == rows(want) and got.select("outcome").distinct().count() == 9 and got.agg(F.max("size")).first()[0] == 3


def test_a_broker_replaces_at_capacity_and_refuses_new_nodes(spark):
    events = [
        (1, "a", "up", 1, None, "connected", None, 1), (2, "b", "up", 2, None, "connected", None, 2), (3, "c", "up", 3, None, "refused", None, 2), (4, "c", "request", 3, "a", "not connected", None, 2),
        (5, "a", "up", 4, None, "replaced", 1, 2), (6, "a", "down", 1, None, "stale", None, 2), (7, "b", "request", 2, "a", "brokered", 4, 2), (8, "b", "request", 2, "b", "unavailable", None, 2),
        (9, "b", "malformed", 2, None, "bad request", None, 2), (10, "b", "request", 2, "x", "unavailable", None, 2), (11, "a", "down", 4, None, "closed", None, 1), (12, "b", "request", 2, "a", "unavailable", None, 1), (13, "c", "up", 5, None, "connected", None, 2),
    ]
    df = spark.createDataFrame([(1, k, k, *e[:4]) for k, *e in events], "group int, id long, at long, key string, kind string, conn long, target string")
    broker = folds.Broker(2)
    got = [(r["outcome"], r["other"], r["size"]) for r in folds.folded(df, broker).orderBy("id").collect()]
    assert got == [tuple(e[5:]) for e in events]


def test_an_expired_node_gives_its_place_back(spark):
    events = [(1, 0, "a", False, 100), (2, 50, "b", False, 100), (3, 120, "b", False, 100), (4, 130, "b", True, 0), (5, 140, "a", True, 0), (6, 150, "b", False, 100), (7, 1000, "c", False, 100), (8, 1050, "d", True, 0), (9, 2000, "d", False, 100)]
    df = spark.createDataFrame([(1, *e) for e in events], "group int, id long, at long, key string, lookup boolean, ttl long")
    got = {r["id"]: (r["outcome"], r["size"]) for r in folds.folded(df, folds.Registry(1, 1000)).collect()}
    # an expired node keeps its place until a lookup (5) or a sweep (at 1000, at 2000) finds it
    assert got == {1: ("new", 1), 2: ("full", 1), 3: ("full", 1), 4: ("absent", 1), 5: ("absent", 0), 6: ("new", 1), 7: ("new", 1), 8: ("absent", 1), 9: ("new", 1)}


def test_a_bounded_limiter_forgets_the_key_quiet_for_longest(spark):
    df = spark.createDataFrame([(1, k, at, key) for k, (at, key) in enumerate([(0, 1), (1, 2), (2, 1), (3, 3), (4, 2), (5, 1), (60_000, 1), (200_000, 1)])], "group int, id long, at long, key long")
    got = [(r["allowed"], r["evicted"], r["size"]) for r in folds.folded(df, folds.Limiter(0.0, 1.0, 2, 100_000, 50_000)).orderBy("id").collect()]
    assert got == [(True, None, 1), (True, None, 2), (False, None, 2), (True, 2, 2), (True, 1, 2), (True, 3, 2), (False, None, 2), (True, None, 1)]


def test_control_loop(spark, parts, rocks, tmp_path):
    """All requests up to the watermark, each at its time, with the dirty paths of its burst."""
    pick = lambda df: df.select((F.col("seq") % 3).cast("string").alias("folder"), "path", F.col("authored_ms").alias("at"))
    waits = dict(debounce_ms=3_600_000, quiesce_ms=2 * 3_600_000, period_ms=86_400_000, jitter_ms=3_600_000)
    got = appended(streams.requests(pick(stream(spark, parts)), "0 seconds", **waits), tmp_path)
    data = spark.read.parquet(parts)
    end = data.agg(F.max("authored_ms")).first()[0]
    want = control.requests(pick(data), **waits).where(F.col("at") < end)
    assert rows(got.where(F.col("at") < end)) == rows(want)
    assert {r["kind"] for r in want.select("kind").distinct().collect()} == {"scan", "snapshot", "rescan"} and want.where("kind = 'scan'").count() > 100


def test_bursts_of_cells_equal_a_fold(spark):
    rng = random.Random(7)
    events = sorted((rng.choice("ab"), rng.randrange(6000), f"p{rng.randrange(5)}") for _ in range(300))
    want = {}
    for folder, at, path in events:
        last = want.setdefault(folder, [])
        if last and at - last[-1][1] < 37:
            last[-1][1] = at
        else:
            last.append([at, at, set(), 0])
        last[-1][2].add(path)
        last[-1][3] += 1
    got = control.bursts(spark.createDataFrame(events, "folder string, at long, path string"), 37).collect()
    assert sorted((r["folder"], r["start_ms"], r["last_ms"], r["paths"], r["events"]) for r in got) == sorted((f, a, b, len(p), n) for f, x in want.items() for a, b, p, n in x)


def test_delta_rows_take_newer_versions(spark):
    schema = "path string, manifest_id string, vector map<string,long>, author string, authored_ms long, deleted boolean"
    now = spark.createDataFrame([("a", "1", {"x": 1}, "x", 10, False), ("b", "1", {"x": 1}, "x", 10, False), ("c", "1", {"x": 2}, "x", 10, False)], schema)
    new = spark.createDataFrame([("a", "2", {"x": 1, "y": 1}, "y", 20, False), ("b", "2", {"y": 1}, "y", 20, False), ("c", "0", {"x": 1}, "x", 5, False), ("d", "1", {"y": 1}, "y", 5, False)], schema)
    got = {r["path"]: r["manifest_id"] for r in streams.delta_rows(now, new).collect()}
    assert {k: got[k] for k in "abcd"} == {"a": "2", "b": "2", "c": "1", "d": "1"}
    assert [v for k, v in got.items() if ".conflict-" in k] == ["1"]
    assert vectors.VERSION == tuple(now.columns)


def test_telemetry_outcomes(spark):
    lines = spark.createDataFrame([("n1", '{"install_id": "i", "schema_version": 1, "event_millis": 5, "fields": "{}"}'), ("n1", "nonsense"), ("n1", '{"install_id": "i", "schema_version": 2, "fields": "{}"}'), ("n2", "{}")], "node_id string, value string")
    got = [r["outcome"] for r in streams.telemetry(lines, F.col("node_id") == "n1").collect()]
    assert got == ["ok", "bad request", "bad version", "denied"]


def test_rows_and_cursor_move_together(spark, tmp_path):
    table = streams.DeltaTable(spark, str(tmp_path), "path string, seq long")
    merge = streams.latest_rows("path", "seq")
    page = lambda *rows: spark.createDataFrame(rows, "path string, seq long")
    assert table.cursor("f", "p") is None
    assert table.apply(page(("a", 1), ("b", 2)), "f", "p", 1, 2, merge)
    assert table.apply(page(("a", 3)), "f", "p", 1, 3, merge) and not table.apply(page(("a", 9)), "f", "p", 1, 3, merge)
    assert table.cursor("f", "p") == (1, 3)
    # rows without their cursor are a version that was not completed
    table.rows.write(page(("lost", 7)), 5)
    assert {tuple(r) for r in table.read().collect()} == {("a", 3), ("b", 2)}
    assert table.apply(page(("c", 1)), "f", "p", 2, 1, merge)
    assert table.cursor("f", "p") == (2, 1) and table.read().count() == 3


def test_merges_of_announcements_presence_and_capped_telemetry(spark):
    now = spark.createDataFrame([("f", "r0", 1)], "folder string, root string, high_water long")
    batch = spark.createDataFrame([("f", "r1", 5, 1), ("f", "r2", 6, 2), ("g", "r3", 1, 1)], "folder string, root string, high_water long, at long")
    assert {tuple(r) for r in streams.coalesced_rows(now, batch).collect()} == {("f", "r2", 6), ("g", "r3", 1)}
    live = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "node_id long, address string, at long")
    events = spark.createDataFrame([(1, "c", 5, True), (2, "b", 6, False), (3, "d", 7, True), (4, "e", 8, True)], "node_id long, address string, at long, up boolean")
    assert {tuple(r) for r in streams.presence_rows(2)(live, events).collect()} == {(1, "c", 5), (3, "d", 7)}
    stored = spark.createDataFrame([(1, "xxxx")], "id long, fields string")
    more = spark.createDataFrame([(k, "yyyy") for k in range(2, 9)], "id long, fields string")
    assert sorted(r["id"] for r in streams.capped_rows(15)(stored, more).collect()) == [1, 2, 3]


def test_scheduled_jobs_and_counters(spark, tmp_path):
    import time

    runs = []
    query = streams.scheduled(spark, "200 milliseconds", runs.append, str(tmp_path / "ck"))
    end = time.time() + 30
    while len(runs) < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert runs[:2] == [0, 1]
    rows, seen = streams.counted(spark.range(10), "served", n=F.count(F.lit(1)), top=F.max("id"))
    rows.collect()
    assert seen.get == {"n": 10, "top": 9}
