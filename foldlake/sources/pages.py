"""Pages of a peer's change feed as a streaming data source: ``spark.readStream.format("pages")``.

A peer publishes the versions of a folder together with the headers of its pages (``publish``).  A consumer's offset is its cursor: the epoch of
the peer's index, the last sequence, and within a version whose chunk list spans pages the chunks that it has.  Each trigger moves the
cursor on by ``pages`` pages at most; with ``grow`` by that many times the pages that the stream has taken before (true: once), if that is more, so
that a consumer who rewrites its table at each batch does so a logarithmic number of times.  The cursor and not a page's number says what comes next, so pages may be cut
anew when the feed has grown; a cursor of another epoch starts from nothing.

Every ``publish`` writes a version of its own, and an offset names the version that it is read from, so a batch that runs again reads
the same rows.  Versions that no consumer reads any more are the publisher's to delete.  The folder must be one that ``pyarrow`` can open on the
driver and on the executors.

Rows: a slice of a version is a row with ``chunk_from`` and ``more``; a whole version has 0 and false.
Headers that do not move the cursor on are an error, so that a broken peer cannot keep a consumer busy for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from foldlake.operators.network import delta_pages

VERSION = "path string, manifest_id string, vector map<string,bigint>, author string, authored_ms bigint, deleted boolean"
CHUNKS = "array<struct<ord:bigint,chunk_id:string,length:bigint>>"
#: A version or a slice of one, as a page carries it.
DELTA = f"seq bigint, {VERSION}, chunks {CHUNKS}, epoch bigint, chunk_from bigint, more boolean"
STORED = ["seq", "path", "manifest_id", "vector", "author", "authored_ms", "deleted", "chunks"]


#: Behind every number of chunks.
MOST = 1 << 62
#: Pages of a task at most, and bytes of a row group: a task decodes little beside its own rows.
TASK, GROUP = 4096, 1 << 20


def publish(feed: DataFrame, root: str, epoch: int, budget: int, row_bytes: int, chunk_bytes: int) -> int:
    """Write the feed (``seq``, the columns of a version, ``chunks``) and its page headers; gives the number of the new version.

    ``seq`` is unique.  Rows and headers are sorted, so a consumer opens only the row groups behind its cursor.  Pages are packed in blocks of
    consecutive versions, one task each: the last page of a block may have room left.
    """
    if budget < row_bytes:
        raise ValueError("a page must have room for a version without chunks")
    spark, root = feed.sparkSession, root.rstrip("/")
    number = max(versions(root), default=-1) + 1
    own = feed.select(*STORED[:-1], F.coalesce("chunks", F.array().cast(CHUNKS)).alias("chunks"))
    ranged = own.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("block", F.spark_partition_id())
    ranged.write.mode("overwrite").option("parquet.block.size", GROUP).parquet(f"{root}/v{number}/rows")
    rows = spark.read.parquet(f"{root}/v{number}/rows").select("block", "seq", F.size("chunks").cast("bigint").alias("chunks"))
    headers = delta_pages(rows.withColumn("folder", F.col("block").cast("string")), budget, row_bytes, chunk_bytes)
    sliced = headers.join(rows.select(F.col("seq").alias("last_seq"), F.col("chunks").alias("_all")), "last_seq")
    more = (F.col("first_seq") == F.col("last_seq")) & (F.col("chunk_to") < F.col("_all"))
    out = sliced.select(F.lit(epoch).cast("bigint").alias("epoch"), "last_seq", F.when(more, F.col("chunk_to")).otherwise(0).alias("chunk"))
    out.orderBy("last_seq", F.when(F.col("chunk") == 0, MOST).otherwise(F.col("chunk"))).write.mode("overwrite").option("parquet.block.size", GROUP).parquet(f"{root}/v{number}/pages")
    return number


def versions(root: str) -> list[int]:
    """Numbers of the versions that were published whole (the headers are written last)."""
    files, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    numbers = [int(f.base_name[1:]) for f in found if f.base_name[:1] == "v" and f.base_name[1:].isdigit()]
    return sorted(n for n in numbers if files.get_file_info(f"{path}/v{n}/pages/_SUCCESS").type == fs.FileType.File)


def table(root: str, version: int, name: str) -> pads.Dataset:
    return pads.dataset(f"{root}/v{version}/{name}", format="parquet")


@dataclass
class Stretch(InputPartition):
    """What lies behind one cursor up to another, of one version of the feed."""

    version: int
    epoch: int
    after: tuple[int, int]
    upto: tuple[int, int]


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.pages, self.parts = int(options.get("pages", 64)), int(options.get("parts", 16))
        if self.pages < 1 or self.parts < 1:
            raise ValueError("pages and parts must be positive")
        grow = str(options.get("grow", "false")).lower()
        self.grow, self.taken = {"false": 0, "true": 1}[grow] if grow in ("false", "true") else int(grow), 0
        if self.grow < 0:
            raise ValueError("grow must not be negative")
        self.at = {"version": int(options.get("version", -1)), "epoch": int(options.get("epoch", -1)), "seq": int(options.get("seq", -1)), "chunk": int(options.get("chunk", 0))}

    def initialOffset(self) -> dict:
        return self.at

    def headers(self, version: int, epoch: int, after: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """Epoch and cursor of the pages behind a cursor, in order."""
        last = None
        for batch in table(self.root, version, "pages").to_batches(columns=["epoch", "last_seq", "chunk"], filter=pads.field("last_seq") >= after[0], batch_size=4096):
            for e, seq, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                # a version whose slices have all come has no chunk in its cursor, and lies behind those of its slices
                here = (seq, chunk or MOST)
                if last is not None and here <= last:
                    raise ValueError(f"the cursor does not move on behind {last}")
                last = here
                if here > (after[0], after[1] or MOST):
                    yield e, seq, chunk

    def latestOffset(self) -> dict:
        found = versions(self.root)
        if not found:
            return self.at
        version, at = found[-1], self.at
        first = next(iter(self.headers(version, at["epoch"], (-1, 0))), None)
        after = (at["seq"], at["chunk"]) if first and first[0] == at["epoch"] else (-1, 0)
        for epoch, seq, chunk in islice(self.headers(version, at["epoch"], after), max(self.pages, self.taken * self.grow)):
            at = {"version": version, "epoch": epoch, "seq": seq, "chunk": chunk}
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        if all(start[k] == end[k] for k in ("epoch", "seq", "chunk")):
            return []
        after = (start["seq"], start["chunk"]) if start["epoch"] == end["epoch"] else (-1, 0)
        upto = end["seq"], end["chunk"]

        def between() -> Iterator[tuple[int, int]]:
            for _, seq, chunk in self.headers(end["version"], end["epoch"], after):
                yield seq, chunk
                if (seq, chunk) == upto:
                    break

        pages = sum(1 for _ in between())
        self.taken += pages
        step = max(1, min(TASK, -(-pages // self.parts)))
        cuts = [*islice(between(), step - 1, max(pages - 1, 0), step), upto]
        return [Stretch(end["version"], end["epoch"], a, b) for a, b in zip([after, *cuts], cuts)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        (a, done), (b, upto) = part.after, part.upto
        seq = pads.field("seq")
        behind = seq >= a if done else seq > a
        for batch in table(self.root, part.version, "rows").to_batches(columns=STORED, filter=behind & (seq <= b), batch_size=1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                begin = done if row[0] == a else 0
                cut = upto if row[0] == b else 0
                vector = None if row[3] is None else dict(row[3])
                chunks = row[7][begin : cut or None]
                yield *row[:3], vector, *row[4:7], [(c["ord"], c["chunk_id"], c["length"]) for c in chunks], part.epoch, begin, cut > 0

    def commit(self, end: dict) -> None:
        self.at = end


class PageSource(DataSource):
    """``spark.dataSource.register(PageSource)`` makes it known as ``pages``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return DELTA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)


def stream(spark: SparkSession, root: str, pages: int = 64, grow: int = 0, **cursor: int) -> DataFrame:
    """Slices behind a cursor (``epoch``, ``seq``, ``chunk``), ``pages`` pages a trigger, or ``grow`` times as many as were taken before."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("pages").option("pages", pages).option("grow", grow).options(**{k: str(v) for k, v in cursor.items()}).load(root)
