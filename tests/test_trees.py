"""The tree source, its change stream and the sink on a temporary folder."""

import os

import pytest
from pyspark.sql import functions as F

from foldlake.sources import files, trees

ROWS = "path string, content binary, kind string, mode int, target string, deleted boolean"


def put(root, name, body=b"", mode=0o644):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body)
    os.chmod(path, mode)


@pytest.mark.parametrize("parts", [1, 3, 256])
def test_listing(spark, tmp_path, parts):
    root = str(tmp_path)
    put(root, "a", b"1", 0o600), put(root, "d/b", b"22"), put(root, "d/e/c", b"333"), put(root, "d/.staging/x", b"no"), put(root, ".staging/y", b"no")
    os.symlink("../a", f"{root}/d/link"), os.symlink("d", f"{root}/folder"), os.mkfifo(f"{root}/d/pipe"), os.mkdir(f"{root}/empty")
    got = {r["path"]: r for r in trees.listing(spark, root, parts=parts).collect()}
    assert {p: r["kind"] for p, r in got.items()} == {"a": "regular", "d": "dir", "d/b": "regular", "d/e": "dir", "d/e/c": "regular", "d/link": "symlink", "folder": "symlink", "d/pipe": "other", "empty": "dir"}
    assert got["a"]["mode"] == 0o600 and got["d/e/c"]["size"] == 3 and got["d/link"]["target"] == "../a" and got["a"]["inode"] == os.stat(f"{root}/a").st_ino
    assert got["a"]["mtime_ns"] == os.stat(f"{root}/a").st_mtime_ns and not any(r["error"] for r in got.values())
    read = trees.listing(spark, f"file://{root}", content=True, parts=parts)
    assert {r["path"]: bytes(r["content"]) for r in read.where("content is not null").collect()} == {"a": b"1", "d/b": b"22", "d/e/c": b"333"}
    assert [r["path"] for r in trees.listing(spark, root, parts=parts).where("path like 'd/e/%'").collect()] == ["d/e/c"]
    assert trees.listing(spark, root, parts=parts).where("path = 'd/b'").count() == 1


def test_filters_close_subtrees(tmp_path):
    from pyspark.sql.datasource import StringStartsWith

    for name in ("a/x/1", "a/y/2", "b/z/3"):
        put(str(tmp_path), name)
    reader = trees.TreeReader({"path": str(tmp_path)})
    kept = StringStartsWith(("path",), "a/x")
    assert list(reader.pushFilters([kept])) == [kept]
    assert sorted(p.folder for p in reader.partitions()) == ["", "a", "a/x"]


def test_a_missing_root_is_an_error(spark, tmp_path):
    for root in (tmp_path / "gone", tmp_path / "file"):
        put(str(tmp_path), "file")
        with pytest.raises(Exception, match="no folder to list"):
            trees.listing(spark, str(root)).collect()


def test_what_cannot_be_read_is_not_gone(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    put(root, "a/x"), put(root, "b/y"), put(root, "b/c/z"), put(root, "d")
    open_ = os.scandir

    def shut(path):
        if str(path).endswith("/b"):
            raise PermissionError(13, "Permission denied")
        return open_(path)

    state = str(tmp_path / "state")
    stream = trees.TreeStream({"path": root, "state": state, "parts": "3"})
    events = lambda a, b: sorted((e[0], e[2]) for p in stream.partitions({"listing": a}, {"listing": b}) for e in stream.read(p))
    assert [p for p, _ in events(0, 1)] == ["a", "a/x", "b", "b/c", "b/c/z", "b/y", "d"]
    monkeypatch.setattr(os, "scandir", shut)
    os.unlink(f"{root}/d")
    for parts in ("1", "100"):
        reader = trees.TreeReader({"path": root, "parts": parts})
        rows = [r for part in reader.partitions() for r in reader.rows(part)]
        assert sorted((r[0], r[7]) for r in rows) == [("a", None), ("a/x", None), ("b", "Permission denied")]
    assert events(1, 2) == [("d", files.REMOVE)]
    assert events(1, 2) == [("d", files.REMOVE)]  # the same listing when a batch runs again
    monkeypatch.undo()
    os.unlink(f"{root}/b/y")
    assert events(2, 3) == [("b/y", files.REMOVE)]
    stream.commit({"listing": 3})
    assert stream.versions() == [3]
    listed = spark.createDataFrame([r[:1] + r[7:] for r in rows], "path string, error string")
    known = spark.createDataFrame([("a/x",), ("b/y",), ("b/c/z",), ("d",), ("bb",)], "path string")
    assert sorted(r["path"] for r in trees.vanished(known, listed).collect()) == ["bb", "d"]


def test_stream_of_changes(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "ck")
    put(root, "a", b"1"), put(root, "d/b", b"2"), put(root, "d/c", b"3"), put(root, "e/f", b"4")
    seen = []

    def look():
        seen.clear()
        stream = trees.changes(spark, root, str(tmp_path / "state"), parts=4)
        stream.writeStream.foreachBatch(lambda b, _: seen.extend((r["path"], r["op"]) for r in trees.with_renames(b).collect())).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    assert look() == [(p, files.CREATE) for p in ("a", "d", "d/b", "d/c", "e", "e/f")]
    assert look() == []
    put(root, "a", b"11")
    os.chmod(f"{root}/d/b", 0o600)
    os.rename(f"{root}/e/f", f"{root}/g")  # from one top folder to another
    os.unlink(f"{root}/d/c")
    put(root, "new/deep/x", b"5")
    assert look() == [("a", files.WRITE), ("d/b", files.CHMOD), ("d/c", files.REMOVE), ("e/f", files.RENAME), ("g", files.CREATE), ("new", files.CREATE), ("new/deep", files.CREATE), ("new/deep/x", files.CREATE)]
    os.rename(f"{root}/new", f"{root}/old")
    assert look() == [(p, op) for first, op in (("new", files.RENAME), ("old", files.CREATE)) for p in (first, f"{first}/deep", f"{first}/deep/x")]
    os.unlink(f"{root}/a"), os.symlink("g", f"{root}/a")
    put(root, "d/b", b"22", 0o644)
    # a link's bits are 777
    assert look() == [("a", files.WRITE | files.CHMOD), ("d/b", files.WRITE | files.CHMOD)]


def test_sink(spark, tmp_path):
    root = str(tmp_path)
    put(root, "old", b"x"), put(root, "gone/y", b"y"), put(root, "bits", b"z", 0o644)
    rows = [("a.txt", b"1", "regular", 0o600, None, False), ("d/b", b"22", None, None, None, None), ("old", b"new", "regular", 0o644, None, False), ("l", None, "symlink", None, "d/b", False), ("e", None, "dir", 0o700, None, False), ("gone/y", None, "regular", None, None, True), ("bits", None, "regular", 0o640, None, False)]
    assert trees.materialise(spark.createDataFrame(rows, ROWS), root) == 7
    got = {r["path"]: (r["kind"], r["mode"], r["target"], r["content"] and bytes(r["content"])) for r in trees.listing(spark, root, content=True).collect()}
    assert got["a.txt"] == ("regular", 0o600, None, b"1") and got["d/b"][3] == b"22" and got["old"][3] == b"new" and got["l"][::2] == ("symlink", "d/b")
    assert got["e"][:2] == ("dir", 0o700) and "gone/y" not in got and got["bits"][1] == 0o640 and got["bits"][3] == b"z"
    assert not os.path.exists(f"{root}/{files.STAGING}")
    # the plain writer places at its commit
    spark.createDataFrame([("p/q", b"7")], "path string, content binary").write.format("tree").mode("append").save(root)
    assert open(f"{root}/p/q", "rb").read() == b"7" and not os.path.exists(f"{root}/{files.STAGING}")


@pytest.mark.parametrize("bad", [("../x", b"1", "regular", None, None, False), ("/etc/x", b"1", "regular", None, None, False), ("", b"1", "regular", None, None, True), ("out/x", b"1", "regular", None, None, False), (".staging/x", b"1", "regular", None, None, False), ("l", None, "symlink", None, "../up", False), ("d/l", None, "symlink", None, "/etc", False), ("d/l", None, "symlink", None, None, False)])
def test_a_failing_task_leaves_nothing_behind(spark, tmp_path, bad):
    root = str(tmp_path / "root")
    os.makedirs(root)
    os.symlink("..", f"{root}/out")
    good = [(f"f{k}", b"1", "regular", None, None, False) for k in range(20)]
    with pytest.raises(Exception, match="leaves the root"):
        trees.materialise(spark.createDataFrame(good + [bad], ROWS).repartition(4), root)
    assert os.listdir(root) == ["out"]


def test_resume(spark, tmp_path, monkeypatch):
    """A run that ends between staging and placing, or in the middle of placing, is brought to its end; one that was not all staged is removed."""
    root = str(tmp_path)
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}", b"%d" % k) for k in range(30)], "path string, content binary").repartition(4)
    rows.write.format("tree").mode("append").option("place", "later").option("job", "j1").save(root)
    put(root, ".staging/j0/task/0", b"half")
    assert os.listdir(root) == [".staging"]
    with open(f"{root}/.staging/j1/_MANIFESTS") as f:
        trees.place(root, f.read().split("\n")[0])
    assert trees.resume(spark, root) == 30
    listed = {r["path"]: bytes(r["content"]) for r in trees.listing(spark, root, content=True).where("kind = 'regular'").collect()}
    assert listed == {f"d{k % 3}/f{k}": b"%d" % k for k in range(30)}
    assert trees.resume(spark, root) == 0


@pytest.mark.parametrize("parts, look", [(1, 1 << 14), (8, 1 << 14), (64, 1 << 14), (64, 30), (1000, 10), (1000, 1 << 14)])
def test_partitions_do_not_grow_with_the_tree(tmp_path, monkeypatch, parts, look):
    """Wide folders and many empty ones are spread over a bounded number of tasks, each path in one of them."""
    for k in range(400):
        put(str(tmp_path), f"s{k % 5}/f{k}")
        os.makedirs(f"{tmp_path}/s{k % 5}/e{k}")
    put(str(tmp_path), "s1/e1/deep/x"), put(str(tmp_path), "top")
    monkeypatch.setattr(trees, "LOOK", look)
    reader = trees.TreeReader({"path": str(tmp_path), "parts": str(parts)})
    split = [[r[0] for r in reader.rows(p)] for p in reader.partitions()]
    assert len(split) <= parts
    want = sorted(os.path.relpath(os.path.join(at, x), tmp_path) for at, dirs, plain in os.walk(tmp_path) for x in dirs + plain)
    assert sorted(p for rows in split for p in rows) == want
    if parts == 64:
        assert max(map(len, split)) < 40  # no folder of 160 entries is one task


def test_files_are_forced_to_disk_before_the_commit(tmp_path, monkeypatch):
    """Every staged file is synced once, whole, after all those that are open with it were written."""
    import pyarrow as pa

    synced, sync = {}, os.fsync
    monkeypatch.setattr(os, "fsync", lambda fd: (synced.__setitem__(os.readlink(f"/proc/self/fd/{fd}"), os.fstat(fd).st_size), sync(fd)) and None)
    writer = trees.TreeWriter({"path": str(tmp_path), "place": "later", "job": "j"})
    bodies = [b"x" * k for k in range(300)]
    staged = writer.write(iter([pa.RecordBatch.from_pydict({"path": [f"f{k}" for k in range(300)], "content": bodies})]))
    assert staged.files == 300 and sorted(synced.values()) == list(range(300))
    writer.commit([staged])
    assert trees.place(str(tmp_path), staged.manifest) == 300 and open(f"{tmp_path}/f299", "rb").read() == bodies[299]


def test_a_tree_is_removed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver is left with folders only; links are removed and not followed."""
    root = str(tmp_path / "in")
    for k in range(300):
        put(root, f"s{k % 3}/f{k}")
    put(root, "s1/deep/er/x"), put(root, ".staging/j/y"), put(str(tmp_path), "out/kept")
    os.makedirs(f"{root}/s0/empty"), os.symlink("../../out", f"{root}/s2/link")
    left, rmtree = [], trees.shutil.rmtree
    monkeypatch.setattr(trees.shutil, "rmtree", lambda at: (left.extend(os.path.join(a, f) for a, _, fs in os.walk(at) for f in fs), rmtree(at)) and None)
    trees.remove(spark, f"file://{root}")
    assert left == [f"{root}/.staging/j/y"] and os.listdir(tmp_path) == ["out"] and os.listdir(tmp_path / "out") == ["kept"]


def test_a_wide_folder_is_spread_over_the_buckets(tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    for k in range(400):
        put(root, f"s/f{k}")
    put(root, "s/d/deep/x"), put(root, "top")
    stream = trees.TreeStream({"path": root, "state": str(tmp_path / "state"), "parts": "8"})
    events = lambda a, b: [[(e[0], e[2]) for e in stream.read(p)] for p in stream.partitions({"listing": a}, {"listing": b})]
    first = events(0, 1)
    assert max(map(len, first)) < 100
    want = sorted(os.path.relpath(os.path.join(at, x), root) for at, dirs, plain in os.walk(root) for x in dirs + plain)
    assert sorted(e for part in first for e in part) == [(p, files.CREATE) for p in want]
    os.unlink(f"{root}/s/f7"), put(root, "s/f400"), put(root, "s/d/deep/x", b"1")
    assert sorted(e for part in events(1, 2) for e in part) == [("s/d/deep/x", files.WRITE), ("s/f400", files.CREATE), ("s/f7", files.REMOVE)]
    # no bucket takes what is in a folder that cannot be read for gone, nor says anything of the folder twice
    open_ = os.scandir

    def shut(path):
        if str(path).endswith("/s"):
            raise PermissionError(13, "Permission denied")
        return open_(path)

    monkeypatch.setattr(os, "scandir", shut)
    os.unlink(f"{root}/s/f8"), os.unlink(f"{root}/top"), os.chmod(f"{root}/s", 0o700)
    assert sorted(e for part in events(2, 3) for e in part) == [("s", files.CHMOD), ("top", files.REMOVE)]
    monkeypatch.undo()
    assert [e for part in events(3, 4) for e in part] == [("s/f8", files.REMOVE)]
    with pytest.raises(FileNotFoundError):
        other = trees.TreeStream({"path": root, "state": str(tmp_path / "state"), "parts": "4"})
        [e for p in other.partitions({"listing": 4}, {"listing": 5}) for e in other.read(p)]
