"""A telemetry store takes records until its cap is reached, each line once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foldlake.streaming.ingest import TelemetryStore
from foldlake.streaming.streams import VersionedTable

LINES = "id long, node_id long, value string"


def line(k, node, fields, version=1):
    return k, node, json.dumps({"install_id": "i", "schema_version": version, "event_millis": k, "fields": fields})


def store(spark, tmp_path, cap):
    return TelemetryStore(spark, str(tmp_path / "store"), cap, lambda: F.col("node_id") != 3)


def test_equals_a_plain_store(spark, tmp_path):
    rng = random.Random(3)
    lines = [line(k, rng.randrange(5), "x" * rng.randrange(30), rng.choice((1, 1, 1, 2))) if rng.random() < 0.9 else (k, 1, "{") for k in range(300)]
    used, want, kept = 0, {}, []
    for k, node, value in lines:
        body = json.loads(value) if value != "{" else None
        want[k] = "denied" if node == 3 else "bad request" if body is None else "bad version" if body["schema_version"] != 1 else "full" if used >= 1500 else "ok"
        if want[k] == "ok":
            used += len(body["fields"])
            kept.append((k, node, body["fields"]))
    own = store(spark, tmp_path, 1500)
    for number, (a, b) in enumerate([(0, 70), (70, 70), (70, 200), (200, 300)]):
        own.step(spark.createDataFrame(lines[a:b], LINES), number)
    assert {r["id"]: r["outcome"] for r in own.outcomes().collect()} == want and set(want.values()) == {"denied", "bad request", "bad version", "full", "ok"}
    assert sorted((r["id"], r["node_id"], r["fields"]) for r in own.records().collect()) == kept
    assert own.size() == (used, len(kept))


def test_a_batch_that_broke_off_counts_once(spark, tmp_path, monkeypatch):
    own, first, second = store(spark, tmp_path, 10), [line(1, 1, "abcdef")], [line(2, 1, "ghijkl"), line(3, 1, "m")]
    own.step(spark.createDataFrame(first, LINES), 0)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "write", lambda *_: (_ for _ in ()).throw(OSError("torn")))
        with pytest.raises(OSError, match="torn"):
            own.step(spark.createDataFrame(second, LINES), 1)
    assert own.size() == (6, 1) and own.records().count() == 1
    for _ in range(2):
        own.step(spark.createDataFrame(second, LINES), 1)
    # the record that reaches the cap is taken, what comes after is not
    assert own.size() == (12, 2) and {r["id"]: r["outcome"] for r in own.outcomes().collect()} == {1: "ok", 2: "ok", 3: "full"}


def test_an_empty_store(spark, tmp_path):
    own = store(spark, tmp_path, 10)
    assert own.size() == (0, 0) and own.records().isEmpty() and own.outcomes().isEmpty()
    own.step(spark.createDataFrame([], LINES), 0)
    assert own.size() == (0, 0)
