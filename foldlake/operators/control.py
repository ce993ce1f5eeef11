"""What a watcher's events lead to: scans of the changed paths, snapshots after a quiet time, periodic rescans.

Events are ``folder, path, at`` (milliseconds).  A quiet time of a gap ends a burst.  Bursts are found on cells, one row for a folder and a
stretch of time as long as the gap: two events of a cell are of one burst, so only the first and last of each cell count, and a folder with
a large share of all events is counted before anything is sorted.  ``streams.control`` is the same over a stream, with timers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(events: DataFrame, gap_ms: int) -> DataFrame:
    """``folder, cell`` with the burst that each cell is in: ``start_ms, last_ms`` of the burst's events."""
    each = events.groupBy("folder", F.floor(F.col("at") / gap_ms).alias("cell")).agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    order = Window.partitionBy("folder").orderBy("cell")
    fresh = F.when(F.col("_lo") - F.lag("_hi").over(order) < gap_ms, 0).otherwise(1)
    burst = F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = Window.partitionBy("folder", "_b")
    return each.withColumn("_f", fresh).withColumn("_b", burst).select("folder", "cell", F.min("_lo").over(own).alias("start_ms"), F.max("_hi").over(own).alias("last_ms"))


def in_bursts(events: DataFrame, gap_ms: int) -> DataFrame:
    """Events with ``start_ms`` and ``last_ms`` of their burst."""
    return events.withColumn("cell", F.floor(F.col("at") / gap_ms)).join(cells(events, gap_ms), ["folder", "cell"]).drop("cell")


def bursts(events: DataFrame, gap_ms: int) -> DataFrame:
    """Per burst ``folder, start_ms, last_ms, paths`` (distinct ones) and ``events``."""
    once = in_bursts(events, gap_ms).groupBy("folder", "start_ms", "last_ms", "path").agg(F.count("*").alias("_n"))
    return once.groupBy("folder", "start_ms", "last_ms").agg(F.count("*").alias("paths"), F.sum("_n").alias("events"))


def step(folder: Column, period_ms: int, jitter_ms: int) -> Column:
    """Time between two rescans of a folder: the period and a delay of the folder's own."""
    return F.lit(period_ms) + F.pmod(F.conv(F.substring(F.sha2(folder.cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(jitter_ms))


def rescans(folders: DataFrame, period_ms: int, jitter_ms: int) -> DataFrame:
    """Times of the periodic scans of each folder (``folder, first_ms, last_ms``): every period plus a delay of its own."""
    every = step(F.col("folder"), period_ms, jitter_ms)
    return folders.select("folder", every.alias("every_ms"), F.floor((F.col("last_ms") - F.col("first_ms")) / every).alias("scans"))


def requests(events: DataFrame, debounce_ms: int = 500, quiesce_ms: int = 2000, period_ms: int = 300_000, jitter_ms: int = 30_000) -> DataFrame:
    """``folder, at, kind, path``: a ``scan`` row for every dirty path of a burst, and ``snapshot`` and ``rescan`` rows without one."""
    none = F.lit(None).cast(events.schema["path"].dataType).alias("path")
    dirty = in_bursts(events, debounce_ms).select("folder", (F.col("last_ms") + debounce_ms).alias("at"), F.lit("scan").alias("kind"), "path").distinct()
    quiet = cells(events, quiesce_ms).select("folder", (F.col("last_ms") + quiesce_ms).alias("at"), F.lit("snapshot").alias("kind"), none).distinct()
    ends = events.groupBy("folder").agg(F.min("at").alias("first_ms"), F.max("at").alias("last_ms"))
    every = rescans(ends, period_ms, jitter_ms).join(ends, "folder").where("scans > 0")
    at = F.explode(F.sequence(F.lit(1).cast("long"), F.col("scans")))
    periodic = every.select("folder", "first_ms", "every_ms", at.alias("_k")).select("folder", (F.col("first_ms") + F.col("_k") * F.col("every_ms")).alias("at"), F.lit("rescan").alias("kind"), none)
    return dirty.unionByName(quiet).unionByName(periodic)
