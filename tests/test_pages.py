"""A replica that follows a peer's pages holds what applying the peer's versions at once gives."""

import pytest
from pyspark.sql import functions as F

from foldlake.sources import pages
from foldlake.streaming import streams
from foldlake.streaming.replica import Replica

FEED = f"seq long, {pages.VERSION}, chunks {pages.CHUNKS}"


def version(seq, chunks, path=None, tag=""):
    return seq, path or f"f{seq}", f"m{seq}{tag}", {"n1": seq}, "n1", 1000 + seq, False, [(k, f"c{seq}{tag}-{k}", 10 * k + 1) for k in range(chunks)]


def feed(spark, *versions):
    return spark.createDataFrame([*versions], FEED)


def lists(replica):
    return {r["seq"]: (r["manifest_id"], [tuple(c) for c in r["chunks"]]) for r in replica.received().collect()}


def want(*versions):
    return {v[0]: (v[2], v[7]) for v in versions}


VERSIONS = [version(1, 2), version(2, 1), version(4, 9), version(5, 0), version(7, 3), version(9, 7)]


def publish(spark, root, epoch, versions, budget=100):
    # a page takes 10 for each version and 20 for each chunk: four chunks of a version that does not fit
    return pages.publish(feed(spark, *versions), root, epoch, budget, 10, 20)


@pytest.mark.parametrize("after", [1, 3, 100])
def test_stops_after_every_batch_and_goes_on(spark, tmp_path, after):
    root, own = str(tmp_path / "peer"), str(tmp_path / "own")
    publish(spark, root, 1, VERSIONS)
    seen = [None]
    while len(seen) < 30:
        # a new object each time: nothing but the table knows where it was
        at = Replica(spark, own, "f", "p").pull(root, after, once=True)
        if at == seen[-1]:
            break
        seen.append(at)
    replica = Replica(spark, own, "f", "p")
    assert seen[-1] == (1, 9, 0) and len(seen) - 1 == {1: 7, 3: 3, 100: 1}[after]
    assert lists(replica) == want(*VERSIONS)
    everything = streams.delta_rows(spark.createDataFrame([], pages.VERSION), feed(spark, *VERSIONS).select(*replica.read().columns))
    assert sorted(map(str, replica.read().collect())) == sorted(map(str, everything.collect()))
    assert replica.carried().isEmpty()
    if after == 1:
        assert (1, 4, 4) in seen and (1, 4, 8) in seen and (1, 9, 4) in seen


def test_a_feed_that_grows_and_one_of_another_epoch(spark, tmp_path):
    root, replica = str(tmp_path / "peer"), Replica(spark, str(tmp_path / "own"), "f", "p")
    assert replica.pull(root) is None  # nothing is published
    assert publish(spark, root, 1, VERSIONS[:2]) == 0
    assert replica.pull(root) == (1, 2, 0)
    # pages are cut anew: the first now ends behind the cursor
    assert publish(spark, root, 1, VERSIONS, budget=400) == 1
    assert replica.pull(root) == (1, 9, 0) and lists(replica) == want(*VERSIONS)
    assert replica.pull(root) == (1, 9, 0)
    other = [version(3, 6, "f3", "x"), version(6, 1, "f4", "x")]
    publish(spark, root, 2, other)
    assert replica.pull(root, 1) == (2, 6, 0)
    assert lists(replica) == want(*VERSIONS, *other)


def test_a_version_replaced_while_it_was_on_its_way_is_dropped(spark, tmp_path):
    root, replica = str(tmp_path / "peer"), Replica(spark, str(tmp_path / "own"), "f", "p")
    publish(spark, root, 1, [version(1, 9, "f")])
    assert replica.pull(root, 1, once=True) == (1, 1, 4) and replica.carried().count() == 1 and replica.read().isEmpty()
    publish(spark, root, 1, [version(2, 1, "f")])
    assert replica.pull(root, 1) == (1, 2, 0)
    assert lists(replica) == want(version(2, 1, "f")) and replica.carried().isEmpty()


def test_a_batch_counts_once_and_a_torn_write_never(spark, tmp_path, monkeypatch):
    root, own = str(tmp_path / "peer"), str(tmp_path / "own")
    publish(spark, root, 1, VERSIONS)
    replica = Replica(spark, own, "f", "p")
    assert replica.pull(root, 3, once=True) == (1, 4, 8)
    write = streams.VersionedTable.write

    def torn(self, df, n):
        if self.path.endswith("cursors"):
            raise OSError("torn")
        write(self, df, n)

    monkeypatch.setattr(streams.VersionedTable, "write", torn)
    with pytest.raises(Exception, match="torn"):
        replica.pull(root, 3, once=True)
    assert Replica(spark, own, "f", "p").position() == (1, 4, 8) and set(lists(replica)) == {1, 2}
    monkeypatch.setattr(streams.VersionedTable, "write", write)
    assert replica.pull(root, 3) == (1, 9, 0) and lists(replica) == want(*VERSIONS)
    before = replica.version()
    again = feed(spark, VERSIONS[0]).select("*", F.lit(1).cast("long").alias("epoch"), F.lit(0).cast("long").alias("chunk_from"), F.lit(False).alias("more"))
    assert not replica.step(again) and replica.version() == before and not replica.step(again.limit(0))


def test_bad_pages_are_refused(spark, tmp_path):
    root = str(tmp_path / "peer")
    with pytest.raises(ValueError, match="room"):
        pages.publish(feed(spark, *VERSIONS), root, 1, 5, 10, 20)
    publish(spark, root, 1, VERSIONS)
    stuck = spark.createDataFrame([(1, 4, 4), (1, 4, 4)], "epoch long, last_seq long, chunk long")
    stuck.coalesce(1).write.mode("overwrite").parquet(f"{root}/v0/pages")
    with pytest.raises(ValueError, match="does not move on"):
        pages.PageStream({"path": root}).latestOffset()
    with pytest.raises(ValueError, match="positive"):
        pages.PageStream({"path": root, "pages": "0"})


def test_pages_of_several_blocks(spark, tmp_path):
    root, replica = str(tmp_path / "peer"), Replica(spark, str(tmp_path / "own"), "f", "p")
    many = [version(k, k % 7) for k in range(1, 60)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        publish(spark, root, 1, many)
    finally:
        spark.conf.set(name, before)
    assert spark.read.parquet(f"{root}/v0/rows").select("block").distinct().count() > 1
    cursors = [(r["last_seq"], r["chunk"] or pages.MOST) for r in spark.read.parquet(f"{root}/v0/pages").collect()]
    assert len(set(cursors)) == len(cursors) and max(cursors) == (59, pages.MOST)
    assert replica.pull(root, 20) == (1, 59, 0) and lists(replica) == want(*many)


def test_an_empty_feed_and_local_rows(spark, tmp_path):
    root, replica = str(tmp_path / "peer"), Replica(spark, str(tmp_path / "own"), "f", "p")
    publish(spark, root, 1, [])
    replica.begin(feed(spark, VERSIONS[0]).select(*replica.read().columns))
    assert replica.pull(root) is None and replica.read().count() == 1
    with pytest.raises(ValueError, match="already"):
        replica.begin(replica.read())


def test_batches_grow_with_what_was_taken(spark, tmp_path):
    """A table that is rewritten at each batch is rewritten a logarithmic number of times."""
    root, replica = str(tmp_path / "peer"), Replica(spark, str(tmp_path / "own"), "f", "p")
    many = [version(k, k % 7) for k in range(1, 40)]
    publish(spark, root, 1, many)
    total = spark.read.parquet(f"{root}/v0/pages").count()
    stream, at, sizes, rows = pages.PageStream({"path": root, "pages": "2", "parts": "3", "grow": "true"}), None, [], []
    while (end := stream.latestOffset()) != at:
        before, at = at or stream.initialOffset(), end
        parts = stream.partitions(before, end)
        assert len(parts) <= 3 + 1
        rows += [r for p in parts for r in stream.read(p)]
        sizes.append(stream.taken)
    assert sizes[-1] == total and sizes[:4] == [2, 4, 8, 16] and len(sizes) <= total.bit_length()
    got = {}
    for r in rows:
        assert len(got.setdefault(r[0], [])) == r[9]
        got[r[0]] += r[7]
    assert got == {v[0]: v[7] for v in many}
    # the pull of a replica has batches of that kind
    assert replica.pull(root, 2) == (1, 39, 0) and lists(replica) == want(*many)
    assert replica.version() + 1 <= len(sizes)


def test_a_replica_rewrites_its_table_for_each_eightfold(spark, tmp_path):
    root, replica = str(tmp_path / "peer"), Replica(spark, str(tmp_path / "own"), "f", "p")
    many = [version(k, k % 7) for k in range(1, 40)]
    publish(spark, root, 1, many)
    total = spark.read.parquet(f"{root}/v0/pages").count()
    assert 16 < total <= 128
    # 2, 16, all
    assert replica.pull(root, 2) == (1, 39, 0) and lists(replica) == want(*many)
    assert replica.version() + 1 == 3
    with pytest.raises(ValueError, match="negative"):
        pages.PageStream({"path": root, "grow": "-1"})
