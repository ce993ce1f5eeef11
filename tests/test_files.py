"""Files by Spark's own source and blob stores on a temporary folder."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from foldlake.sources import files


def put(root, **named):
    for name, body in named.items():
        path = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)


def test_tree_lists_files_below_the_root(spark, tmp_path):
    put(str(tmp_path), a=b"1", d__b=b"22", d__e__c=b"333")
    got = {r["path"]: r["size"] for r in files.tree(spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "d/b": 2, "d/e/c": 3}
    assert files.tree(spark, str(tmp_path), content=True).where("path = 'd/b'").first()["content"] == b"22"


def test_a_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.tree(spark, str(tmp_path / "gone")).collect()


def test_events_of_new_files(spark, tmp_path):
    root = str(tmp_path / "in")
    put(root, a=b"1")
    out, seen = str(tmp_path / "ck"), []

    def run():
        stream = files.events(spark, root)
        stream.writeStream.foreachBatch(lambda b, _: seen.extend(r["path"] for r in b.collect())).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()

    run()
    put(root, d__b=b"2")
    run()
    assert seen == ["a", "d/b"]


def test_blob_store(spark, tmp_path):
    store = files.BlobStore(spark, str(tmp_path / "blobs"))
    blobs = spark.createDataFrame([("aa01", b"1", 1), ("aa02", b"2", 1), ("ff01", b"3", 1)], "id string, data binary, mod_ms long")
    assert store.all().count() == 0 and store.missing(blobs).count() == 3
    store.put(blobs)
    store.put(blobs.where("id = 'ff01'").withColumn("data", F.lit(b"4")).withColumn("mod_ms", F.lit(2).cast("long")))
    rows = lambda df: sorted((r["id"], bytes(r["data"]), r["mod_ms"]) for r in df.collect())
    assert rows(store.get(blobs.where("id <> 'aa02'"))) == [("aa01", b"1", 1), ("ff01", b"4", 2)]
    assert store.missing(spark.createDataFrame([("aa01",), ("bb01",)], "id string")).first()["id"] == "bb01"
    store.delete(blobs.where("id = 'aa01'").select("id"))
    assert [r[0] for r in rows(store.all())] == ["aa02", "ff01"]
    assert [r["id"] for r in store.page("aa", 1).collect()] == ["aa02"]
    store.compact()
    assert [r[0] for r in rows(store.all())] == ["aa02", "ff01"]
    assert len(store._folders("")) == 1
    store.put(blobs.where("id = 'aa01'"))
    assert len(rows(store.all())) == 3


def test_blob_store_survives_a_stop_at_every_step(spark, tmp_path, monkeypatch):
    """Whatever a stopped delete or compaction leaves, what was there is there."""
    store = files.BlobStore(spark, str(tmp_path / "blobs"))
    blobs = spark.createDataFrame([(f"{k:02x}01", b"1", 1) for k in range(6)], "id string, data binary, mod_ms long")
    store.put(blobs)
    store.delete(blobs.where("id < '02'").select("id"))
    want = ["0201", "0301", "0401", "0501"]
    ids = lambda: sorted(r["id"] for r in store.all().select("id").collect())
    # a delete that has written files but not committed them
    store.delete(blobs.where("id = '0301'").select("id"))
    os.remove(f"{store.path}/n=3/_SUCCESS")
    assert ids() == want
    store.delete(blobs.where("id = '0201'").select("id"))
    assert store._folders("") == [1, 2, 3, 4] and ids() == want[1:]
    # a compaction that ends after the write, and after each folder that it drops
    before = store._folders("")
    store._write(store.all().withColumn("gone", F.lit(False)))
    for k in before:
        assert ids() == want[1:]
        shutil.rmtree(f"{store.path}/n={k}")
    assert ids() == want[1:]
