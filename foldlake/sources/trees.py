"""File trees as a Spark data source: ``tree`` lists a tree, streams its changes and takes rows as files.

``binaryFile`` has neither modes, inodes and link targets nor an account of what it could not read, so this source goes to the file system
itself.  Driver and executors must see the root under one path (a mounted share); a listing is one task a subtree or a share of one, a change stream one
task a bucket of paths, and files are staged and placed by tasks.

Listing (``spark.read.format("tree").load(root)``): one row a path below the root with ``path, kind, mode, size, mtime_ns, inode, target,
error`` (and ``content`` of regular files with the option of that name).  Folders named ``.staging`` are passed over wherever they are.  A folder that
cannot be read is a row with its ``error``; what is below it is unknown and not gone (``vanished``).  A root that is no folder is an error.

Stream (``readStream.format("tree").option("state", folder)``): an offset is the number of a listing; the listing of each bucket is
stored under it once, first writer first, so a batch that runs again sees the same tree.  Events have one mask of ``files.CREATE`` ..
``files.CHMOD`` each; ``with_renames`` joins a batch's removals and creations by inode.

Sink (``df.write.format("tree").mode("append").save(root)``): tasks stage, the commit places; ``placed`` does the placing in tasks.
"""

from __future__ import annotations

import os
import shutil
import stat
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage

from foldlake.sources.files import CHMOD, CREATE, REMOVE, RENAME, STAGING, WRITE

LISTING = "path string, kind string, mode int, size long, mtime_ns long, inode long, target string, error string"
EVENTS = "path string, kind string, op int, mode int, size long, mtime_ns long, inode long, version long"
ENTRY = pa.schema([("path", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("inode", pa.int64()), ("target", pa.string()), ("error", pa.string())])
#: Rows and bytes of content of a batch on its way to Spark.
ROWS, BYTES = 4096, 4 << 20
#: Entries that the driver looks at before it leaves the rest to tasks; files that a task has open while they go to disk.
LOOK, OPEN = 1 << 14, 128


def local(path: str) -> str:
    """A path of the mounted file system; ``file:`` may stand before it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"a tree is read from a mounted file system, not from {path}")
    return path.rstrip("/") or "/"


def kind_of(mode: int) -> str:
    return "symlink" if stat.S_ISLNK(mode) else "dir" if stat.S_ISDIR(mode) else "regular" if stat.S_ISREG(mode) else "other"


def entry(root: str, path: str) -> tuple | None:
    """The row of one path by ``lstat``; none if it has gone meanwhile."""
    full = f"{root}/{path}"
    try:
        s = os.lstat(full)
        kind = kind_of(s.st_mode)
        return path, kind, stat.S_IMODE(s.st_mode), s.st_size if kind == "regular" else 0, s.st_mtime_ns, s.st_ino, os.readlink(full) if kind == "symlink" else None, None
    except FileNotFoundError:
        return None
    except OSError as e:
        return path, "other", None, None, None, None, None, e.strerror


def names(root: str, folder: str) -> tuple[list[str], str | None]:
    """What a folder holds, as paths in order, or why it cannot be read."""
    try:
        with os.scandir(f"{root}/{folder}" if folder else root) as found:
            return sorted(f"{folder}/{e.name}" if folder else e.name for e in found if e.name != STAGING), None
    except FileNotFoundError:
        return [], None
    except OSError as e:
        return [], e.strerror


def walk(root: str, folder: str, deep: bool, share: int = 0, of: int = 1) -> Iterator[tuple]:
    """Rows of what is in a folder, and below it if ``deep``; a folder that cannot be read has its row with the error.

    Of ``of`` walks each takes its ``share`` of the folder's own entries, by their names, with what is below them.
    """
    below, error = names(root, folder)
    if of > 1:
        below = [p for p in below if zlib.crc32(os.fsencode(p)) % of == share]
    todo = below[::-1]
    if error and folder:
        yield (*entry(root, folder)[:7], error)
    while todo:
        row = entry(root, todo.pop())
        if row is None:
            continue
        if row[1] == "dir" and deep:
            more, error = names(root, row[0])
            row = (*row[:7], error)
            todo += more[::-1]
        yield row


def check_root(root: str) -> str:
    if not os.path.isdir(root):
        raise NotADirectoryError(f"no folder to list: {root}")
    return root


@dataclass
class Subtree(InputPartition):
    folder: str
    deep: bool
    share: int = 0
    of: int = 1


class TreeReader(DataSourceReader):
    """``parts`` partitions at most: the driver opens folders from the root down while it has few to look at.

    Below, a partition takes a share of a folder's entries, so neither a wide folder nor many small ones make it one task or a task each.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.content, self.parts = local(options["path"]), options.get("content", "false").lower() == "true", int(options.get("parts", 256))
        self.only: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Subtrees that no wanted path can be in are not opened; Spark tests the rows themselves again."""
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute == ("path",):
                self.only.append(f.value)
            yield f

    def wanted(self, folder: str) -> bool:
        return all(x.startswith(folder + "/") or (folder + "/").startswith(x) for x in self.only)

    def partitions(self) -> list[InputPartition]:
        check_root(self.root)
        level, out, seen = [""], [], 0
        while level and len(out) + len(level) < self.parts:
            below = []
            for folder in level:
                for e in self.opened(folder):
                    seen += 1
                    if seen > LOOK:
                        break
                    below += [e] if e else []
            if seen > LOOK or len(out) + len(level) + len(below) > self.parts:
                break
            out += [Subtree(folder, False) for folder in level]
            level = sorted(below)
        of = max(1, (self.parts - len(out)) // max(1, len(level)))
        return out + [Subtree(folder, True, share, of) for folder in level for share in range(of)]

    def opened(self, folder: str) -> Iterator[str | None]:
        """For each entry of a folder its path if it is a folder to go into; nothing of one that cannot be read."""
        try:
            with os.scandir(f"{self.root}/{folder}" if folder else self.root) as found:
                for e in found:
                    path = f"{folder}/{e.name}" if folder else e.name
                    yield path if e.name != STAGING and e.is_dir(follow_symlinks=False) and self.wanted(path) else None
        except OSError:
            return

    def rows(self, part: Subtree) -> Iterator[tuple]:
        opened = part.folder
        for row in walk(self.root, opened, part.deep, part.share, part.of):
            # a folder that is a partition of its own is listed here, by the folder that it is in, with what its partition will find
            if row[1] == "dir" and not part.deep and row[0] != opened:
                row = (*row[:7], names(self.root, row[0])[1])
            if row[0] != opened:
                yield row

    def read(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        held, data, size = [], [], 0
        schema = ENTRY.append(pa.field("content", pa.binary())) if self.content else ENTRY

        def made() -> pa.RecordBatch:
            columns = [*zip(*held), data] if self.content else zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for row in self.rows(part):
            body = None
            if self.content and row[1] == "regular":
                try:
                    with open(f"{self.root}/{row[0]}", "rb") as f:
                        body = f.read()
                except OSError as e:
                    row = (*row[:7], e.strerror)
            held.append(row), data.append(body)
            size += len(body or b"")
            if len(held) >= ROWS or size >= BYTES:
                yield made()
                held, data, size = [], [], 0
        if held:
            yield made()


@dataclass
class Bucket(InputPartition):
    number: int
    start: int
    end: int


class TreeStream(DataSourceStreamReader):
    """Changes between one listing and the next; ``parts`` buckets by the first two names of a path, which it never changes.

    So a wide top folder is spread over the buckets; each lists its names and looks at those of its own.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.state, self.parts = local(options["path"]), local(options["state"]), int(options.get("parts", 16))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def versions(self) -> list[int]:
        found = os.listdir(self.state) if os.path.isdir(self.state) else []
        return sorted(int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit())

    def latestOffset(self) -> dict:
        check_root(self.root)
        return {"listing": max(self.versions(), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Bucket(k, start["listing"], end["listing"]) for k in range(self.parts)] if start != end else []

    def kept(self, version: int, number: int) -> str:
        """Where a bucket's listing is; with other buckets its name is another, so they are not taken for these."""
        return f"{self.state}/v{version}/{number}-of-{self.parts}"

    def stored(self, version: int, number: int) -> dict[str, tuple]:
        if not version:
            return {}
        path = self.kept(version, number)
        return {row[0]: row for row in zip(*(c.to_pylist() for c in feather.read_table(path, memory_map=False).columns))}

    def listed(self, part: Bucket, before: dict[str, tuple]) -> dict[str, tuple]:
        """The listing of a bucket at the end of a batch, as its first reader found it."""
        path = self.kept(part.end, part.number)
        if os.path.exists(path):
            return self.stored(part.end, part.number)
        with os.scandir(check_root(self.root)) as found:
            tops = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in found if e.name != STAGING)
        rows, closed = {}, set()
        for top, folder in tops:
            own = zlib.crc32(os.fsencode(top)) % self.parts == part.number
            first = entry(self.root, top) if own else None
            if first:
                rows[top] = first
            for r in walk(self.root, top, True, part.number, self.parts) if folder else ():
                if own or r[0] != top:
                    rows[r[0]] = r
                if r[7] is not None:
                    closed.add(r[0])
        shut = tuple(p + "/" for p in closed)
        if shut:
            # what was known below a folder that cannot be read now stays as it was
            rows |= {p: r for p, r in before.items() if p.startswith(shut) and p not in rows}
        os.makedirs(os.path.dirname(path), exist_ok=True)
        new = f"{path}.{uuid.uuid4().hex}"
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows.values()), ENTRY)], schema=ENTRY) if rows else ENTRY.empty_table()
        feather.write_feather(table, new)
        try:
            os.link(new, path)  # fails if another attempt was first
        except FileExistsError:
            pass
        os.unlink(new)
        return self.stored(part.end, part.number)

    def read(self, part: Bucket) -> Iterator[tuple]:
        before = self.stored(part.start, part.number)
        after = self.listed(part, before)
        for path, row in after.items():
            op = changed(before.get(path), row)
            if op:
                yield path, row[1], op, *row[2:6], part.end
        for path, row in before.items():
            if path not in after:
                yield path, row[1], REMOVE, *row[2:6], part.end

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are not needed any more."""
        for version in self.versions():
            if version < end["listing"]:
                shutil.rmtree(f"{self.state}/v{version}", ignore_errors=True)


def changed(old: tuple | None, new: tuple) -> int:
    """Mask of what has become of a path: a folder's own time and size do not count."""
    if old is None:
        return CREATE
    written = old[1] != new[1] or old[6] != new[6] or (new[1] != "dir" and (old[3:5] != new[3:5] or old[5] != new[5]))
    return WRITE * written | CHMOD * (old[2] != new[2])


@dataclass
class Staged(WriterCommitMessage):
    manifest: str
    files: int


class TreeWriter(DataSourceArrowWriter):
    """Tasks stage contents under ``<root>/.staging/<job>``; what a failed job has staged is removed.

    Rows: ``path, content`` and, if there, ``kind`` (regular), ``mode``, ``target`` and ``deleted``.  A regular row without content changes the
    mode only.  A path that would leave the root, through a link in the tree too, fails its task before anything is placed.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.later = local(options["path"]), options.get("place", "commit") == "later"
        self.stage = f"{self.root}/{STAGING}/{options.get('job', uuid.uuid4().hex)}"
        os.makedirs(self.stage, mode=0o700)  # by the driver only: a task that outlives an abort has no place to write to

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = f"{self.stage}/{uuid.uuid4().hex}"
        os.mkdir(task, mode=0o700)
        n, rows = 0, []
        for part in (b.slice(k, OPEN) for b in batches for k in range(0, b.num_rows, OPEN)):
            with ExitStack() as files:
                held = []
                for row in part.to_pylist():
                    path, kind, deleted = row["path"], row.get("kind") or "regular", bool(row.get("deleted"))
                    inside(self.root, path)
                    target = row.get("target") if kind == "symlink" else None
                    if kind == "symlink" and not deleted:
                        lands = os.path.normpath(os.path.join(os.path.dirname(path), target or "/"))
                        if lands.startswith("/") or lands.split("/")[0] == "..":
                            raise ValueError(f"link target leaves the root: {path!r}")
                    body = None if deleted or kind != "regular" or row.get("content") is None else f"{task}/{n}"
                    if body:
                        held.append(f := files.enter_context(open(body, "wb")))
                        f.write(row["content"])
                        f.flush()
                    rows.append((path, "deleted" if deleted else kind, row.get("mode"), target, body))
                    n += 1
                # all are written before the first is forced to disk, so they share the journal's commits
                if held:
                    with ThreadPoolExecutor(8) as pool:
                        list(pool.map(lambda f: os.fsync(f.fileno()), held))
        manifest = f"{task}/manifest"
        feather.write_feather(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PLACING)], schema=PLACING), manifest)
        return Staged(manifest, len(rows))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        manifests = [m.manifest for m in messages if m]
        with open(f"{self.stage}/_manifests.part", "w") as f:
            f.write("\n".join(manifests))
        os.rename(f"{self.stage}/_manifests.part", f"{self.stage}/_MANIFESTS")  # from here on the job goes forward
        if not self.later:
            for m in manifests:
                place(self.root, m)
            shutil.rmtree(self.stage, ignore_errors=True)
            clear(self.root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        gone = f"{self.stage}-{uuid.uuid4().hex}"
        os.rename(self.stage, gone)
        while os.path.isdir(gone):
            shutil.rmtree(gone, ignore_errors=True)  # again if a running task has put a last file there
        clear(self.root)


PLACING = pa.schema([("path", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("target", pa.string()), ("body", pa.string())])


def clear(root: str) -> None:
    try:
        os.rmdir(f"{root}/{STAGING}")
    except OSError:
        pass


def inside(root: str, path: str | None) -> str:
    """Where a path goes; an error if it is not below the root, or if a folder on its way is a link."""
    parts = (path or "").split("/")
    if not path or any(x in ("", ".", "..") for x in parts) or parts[0] == STAGING:
        raise ValueError(f"path leaves the root: {path!r}")
    at = root
    for x in parts[:-1]:
        at = f"{at}/{x}"
        if os.path.islink(at):
            raise ValueError(f"path leaves the root: {path!r}")
    return f"{root}/{path}"


def place(root: str, manifest: str) -> int:
    """Put a task's staged files in their places; what has been placed before stays, so a second run ends the first."""
    rows = list(zip(*(c.to_pylist() for c in feather.read_table(manifest, memory_map=False).columns)))
    for path, kind, mode, target, body in rows:
        to = inside(root, path)
        if kind == "deleted":
            if os.path.isdir(to) and not os.path.islink(to):
                if not os.listdir(to):
                    os.rmdir(to)
            elif os.path.lexists(to):
                os.unlink(to)
            continue
        os.makedirs(to if kind == "dir" else os.path.dirname(to), exist_ok=True)
        if kind == "symlink":
            new = f"{manifest}.link"
            if os.path.lexists(new):
                os.unlink(new)
            os.symlink(target, new)
            os.rename(new, to)
        elif body and os.path.exists(body):
            if mode is not None:
                os.chmod(body, mode)
            os.rename(body, to)
        if mode is not None and kind != "symlink" and os.path.exists(to):
            os.chmod(to, mode)
    return len(rows)


class TreeSource(DataSource):
    """``spark.dataSource.register(TreeSource)`` makes it known as ``tree``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return EVENTS if "state" in self.options else LISTING + ", content binary" * (self.options.get("content", "false").lower() == "true")

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a tree takes rows in mode append")
        return TreeWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark


def listing(spark: SparkSession, root: str, content: bool = False, parts: int = 256) -> DataFrame:
    return register(spark).read.format("tree").option("content", content).option("parts", parts).load(root)


def changes(spark: SparkSession, root: str, state: str, parts: int = 16) -> DataFrame:
    """A stream of events; ``state`` is a folder outside of the root that all executors share."""
    return register(spark).readStream.format("tree").option("state", state).option("parts", parts).load(root)


def with_renames(batch: DataFrame) -> DataFrame:
    """Events of a batch in which a path that went away while its inode came up at another path counts as renamed."""
    came = batch.where(F.col("op").bitwiseAND(CREATE) != 0).select(F.col("inode").alias("_i"), F.col("kind").alias("_k")).distinct()
    gone = (F.col("op") == REMOVE) & F.col("_i").isNotNull()
    return batch.join(came, (F.col("inode") == F.col("_i")) & (F.col("kind") == F.col("_k")), "left").withColumn("op", F.when(gone, RENAME).otherwise(F.col("op"))).drop("_i", "_k")


def vanished(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths of ``known`` that are not listed and not below a folder that could not be read."""
    shut = listed.where(F.col("error").isNotNull()).select(F.col("path").alias("_above"))
    gone = known.join(listed.select("path"), "path", "left_anti")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    hidden = gone.select("path", F.explode(above).alias("_above")).join(shut, "_above", "left_semi").select("path").distinct()
    return gone.join(hidden, "path", "left_anti")


def materialise(rows: DataFrame, root: str) -> int:
    """Write rows as files below a root: stage all in tasks, then place all in tasks.  Returns the number of rows.

    Nothing is placed unless everything is staged.  A run that ends between the two is brought to its end by ``resume``.
    """
    spark, job = register(rows.sparkSession), uuid.uuid4().hex
    rows.write.format("tree").mode("append").option("place", "later").option("job", job).save(root)
    return placed(spark, root, job)


def placed(spark: SparkSession, root: str, job: str) -> int:
    """Place a staged job, one task a manifest, and remove its staging folder."""
    base = local(root)
    stage = f"{base}/{STAGING}/{job}"

    def run(frames: Iterator) -> Iterator:
        for pdf in frames:
            yield pdf.assign(rows=[place(base, m) for m in pdf["manifest"]])[["rows"]]

    with open(f"{stage}/_MANIFESTS") as f:
        manifests = [(line,) for line in f.read().split("\n") if line]  # one a task
    n = spark.createDataFrame(manifests, "manifest string").repartition(max(1, len(manifests))).mapInPandas(run, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    shutil.rmtree(stage)
    clear(base)
    return n


def remove(spark: SparkSession, root: str) -> None:
    """Remove a tree: what a listing finds in its tasks, then the few folders that several tasks have shared on the driver."""
    base = local(root)

    def run(frames: Iterator) -> Iterator:
        folders, n = [], 0
        for pdf in frames:
            for path, kind in zip(pdf["path"], pdf["kind"]):
                if kind == "dir":
                    folders.append(path)
                    continue
                n += 1
                try:
                    os.unlink(f"{base}/{path}")
                except FileNotFoundError:
                    pass  # an attempt before has removed it
        for path in reversed(folders):
            try:
                os.rmdir(f"{base}/{path}")
            except OSError:
                pass  # not empty: other tasks have a share of it
        yield pd.DataFrame({"n": [n]})

    listing(spark, root).select("path", "kind").mapInPandas(run, "n long").agg(F.sum("n")).first()
    shutil.rmtree(base)


def resume(spark: SparkSession, root: str) -> int:
    """End what earlier runs have left, while none is at work: jobs that were staged as a whole are placed, others are removed."""
    base, n = local(root), 0
    for job in sorted(os.listdir(f"{base}/{STAGING}")) if os.path.isdir(f"{base}/{STAGING}") else []:
        if os.path.exists(f"{base}/{STAGING}/{job}/_MANIFESTS"):
            n += placed(spark, root, job)
        else:
            shutil.rmtree(f"{base}/{STAGING}/{job}", ignore_errors=True)
    clear(base)
    return n
