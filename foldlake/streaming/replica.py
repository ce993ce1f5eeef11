"""A replica of a folder that follows a peer's pages: its rows, the version in progress and the cursor are one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldlake.operators import sync
from foldlake.session import release, settled
from foldlake.sources import pages
from foldlake.streaming.streams import DeltaTable, VersionedTable, delta_rows


class Replica(DeltaTable):
    """A version counts once its rows, slices, chunk lists and, last, its cursor are there; what a crash leaves behind is written anew.

    A version whose chunk list spans pages is carried as slices and applied when the last has come.  Slices of a version that the peer has
    replaced in between, and those of another epoch, are dropped.  ``lists`` holds the chunk list of every manifest received.
    """

    #: A batch may take this many times the pages before it: the table is rewritten for each eightfold of what has come.
    GROW = 7
    LIST = f"seq bigint, manifest_id string, chunks {pages.CHUNKS}"

    def __init__(self, spark: SparkSession, path: str, folder: str, peer: str):
        super().__init__(spark, path, pages.VERSION)
        path = path.rstrip("/")
        self.spark, self.folder, self.peer, self.checkpoint = spark, folder, peer, f"{path}/checkpoint"
        self.slices, self.lists = VersionedTable(spark, f"{path}/slices", pages.DELTA), VersionedTable(spark, f"{path}/lists", self.LIST)

    def begin(self, rows: DataFrame) -> None:
        """Start from local rows, with no cursor."""
        if self.version() >= 0:
            raise ValueError("the replica is there already")
        self._write(0, rows, *(self.spark.createDataFrame([], s) for s in (pages.DELTA, self.LIST, self.CURSOR)))

    def _write(self, n: int, rows: DataFrame, slices: DataFrame, lists: DataFrame, cursors: DataFrame) -> None:
        self.rows.write(rows, n)
        self.slices.write(slices, n)
        self.lists.write(lists, n)
        self.cursors.write(cursors, n)

    def carried(self) -> DataFrame:
        return self.slices.read(before=self.version() + 1)

    def received(self) -> DataFrame:
        """``seq, manifest_id, chunks`` of every version that was applied; each version of the table adds its own."""
        there = [v for v in self.lists.versions() if v <= self.version()]
        return self.spark.read.schema(self.LIST).parquet(*(f"{self.lists.path}/v{v}" for v in there)) if there else self.spark.createDataFrame([], self.LIST)

    def position(self) -> tuple[int, int, int] | None:
        """Epoch, sequence and chunks: where the next page begins."""
        at = self.cursor(self.folder, self.peer)
        if at is None:
            return None
        # slices are there of one version at most, the one that the cursor names
        chunks = self.carried().where((F.col("epoch") == at[0]) & (F.col("seq") == at[1])).agg(F.sum(F.size("chunks"))).first()[0]
        return *at, chunks or 0

    def step(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] = delta_rows) -> bool:
        """Apply a batch of slices; says whether it did (one that was applied before does nothing)."""
        batch = settled(batch)
        try:
            end = F.struct("epoch", "seq", (F.col("chunk_from") + F.size("chunks")).alias("upto"), "more")
            last = batch.agg(F.max_by(end, F.struct("seq", "chunk_from"))).first()[0]
            if last is None:
                return False
            epoch, seq, upto, more = last
            at = self.position()
            behind = lambda s, c: (s, c or pages.MOST)
            if at and at[0] == epoch and behind(seq, upto if more else 0) <= behind(*at[1:]):
                return False
            both = self.carried().where(F.col("epoch") == epoch).unionByName(batch)
            n = self.version() + 1
            done = settled(self._whole(both))
            moved = self.spark.createDataFrame([(self.folder, self.peer, epoch, seq, 0)], self.CURSOR + ", at long")
            carry = both.where((F.col("seq") == seq) & F.lit(more))
            fresh = done.select(*self.read().columns)
            self._write(n, merge(self.read(), fresh), carry, done.select("seq", "manifest_id", "chunks"), sync.advanced(self.cursors.read(), moved))
            release(done)
            return True
        finally:
            release(batch)

    @staticmethod
    def _whole(slices: DataFrame) -> DataFrame:
        """Versions whose last slice is there and that have no gap; whole ones pass without a shuffle."""
        single = (F.col("chunk_from") == 0) & ~F.col("more")
        meta = [c for c in slices.columns if c not in ("epoch", "seq", "chunks", "chunk_from", "more")]
        parts = F.array_sort(F.collect_list(F.struct("chunk_from", "chunks", "more")))
        each = slices.where(~single).groupBy("epoch", "seq").agg(F.first(F.struct(*meta)).alias("m"), parts.alias("p"))
        joined = each.select("epoch", "seq", "m.*", F.flatten("p.chunks").alias("chunks"), F.element_at("p", -1).alias("_last"))
        complete = ~F.col("_last.more") & (F.size("chunks") == F.col("_last.chunk_from") + F.size("_last.chunks"))
        columns = ["seq", *meta, "chunks"]
        return slices.where(single).select(*columns).unionByName(joined.where(complete).select(*columns))

    def follow(self, root: str, pages_: int = 64, once: bool = False) -> StreamingQuery:
        """Start the stream behind the cursor of the table; ``once`` stops it after one batch.

        The first batch has ``pages_`` pages at most.  Each batch rewrites the rows, so a later one may take ``GROW`` times those before it together.
        """
        at = self.position()
        cursor = dict(zip(("epoch", "seq", "chunk"), at)) if at else {}
        writer = pages.stream(self.spark, root, pages_, grow=self.GROW, **cursor).writeStream.foreachBatch(lambda batch, _: self.step(batch) and None)
        writer = writer.option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()

    def pull(self, root: str, pages_: int = 64, once: bool = False) -> tuple[int, int, int] | None:
        """Follow until nothing is left (or for one batch) and say where the cursor stands."""
        query = self.follow(root, pages_, once)
        try:
            query.awaitTermination() if once else query.processAllAvailable()
        finally:
            query.stop()
        return self.position()
