"""Closed intervals: merging, and whether their union covers a chunk."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import ROWS_A_SLICE, time_slices


def merge_intervals(df: DataFrame, by: Sequence[str], start: str = "range_start", end: str = "range_end", rows_a_slice: int = ROWS_A_SLICE) -> DataFrame:
    """Islands of intervals that overlap or touch, per ``by``: the columns by, start, end and ``n`` merged ones.

    Beyond ``rows_a_slice`` rows, starts are cut into slices of time, so that a key's rows are spread over
    tasks. How far the slices before one reach, and how many islands they began, are a row a key and slice.
    """
    rows = df.select(*by, start, end)
    cut = time_slices(rows, start, rows_a_slice)
    keys = [*by, "_slice"]
    rows = rows.withColumn("_slice", cut[0](F.col(start)) if cut else F.lit(0))
    if cut:
        earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        tops = rows.groupBy(*keys).agg(F.max(end).alias("_top"))
        rows = _with(rows, tops.select(*keys, F.max("_top").over(earlier).alias("_before")), keys)
    else:
        rows = rows.withColumn("_before", F.lit(None).cast(df.schema[end].dataType))
    w = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_before")
    rows = rows.withColumn("_begins", F.when(F.col(start) <= reached, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if cut:
        begun = rows.groupBy(*keys).agg(F.sum("_begins").alias("_begun"))
        begun = begun.select(*keys, F.coalesce(F.sum("_begun").over(earlier), F.lit(0)).alias("_count"))
        rows = _with(rows, begun, keys).withColumn("_island", F.col("_island") + F.col("_count"))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def _with(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An equi-join in which null keys are equal."""
    x, y = rows.alias("x"), few.alias("y")
    same = reduce(and_, [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`")) for k in keys])
    return x.join(y, same).select("x.*", *[f"y.{c}" for c in few.columns if c not in keys])


def covered_chunks(chunks: DataFrame, objects: DataFrame, by: Sequence[str]) -> DataFrame:
    """The chunks (by, chunk_start, chunk_end) with ``covered``: whether one island of the objects holds the chunk.

    An equi-join on ``by`` with the merged islands, which are few.
    """
    islands = merge_intervals(objects, by)
    held = chunks.join(islands, list(by), "left")
    inside = (F.col("range_start") <= F.col("chunk_start")) & (F.col("range_end") >= F.col("chunk_end"))
    return held.groupBy(*by, "chunk_start", "chunk_end").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("covered"))


def islands(intervals: Iterable[tuple[datetime, datetime]]) -> tuple[list[datetime], list[datetime]]:
    """Starts and ends, both rising, of the islands of a manifest's intervals: a sweep over all their ends on the driver.

    At one time what opens comes before what closes, so intervals that touch share an island.
    """
    edges = sorted(edge for a, b in intervals for edge in ((a, 0), (b, 1)))
    starts: list[datetime] = []
    ends: list[datetime] = []
    running = 0
    for at, closes in edges:
        if closes:
            running -= 1
            if not running:
                ends.append(at)
        else:
            if not running:
                starts.append(at)
            running += 1
    return starts, ends


def covers(found: tuple[list[datetime], list[datetime]], start: datetime, end: datetime) -> bool:
    """Whether one of the islands holds [start, end]."""
    starts, ends = found
    at = bisect_right(starts, start) - 1
    return at >= 0 and ends[at] >= end
