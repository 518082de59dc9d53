"""Joins along time that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import ROWS_A_SLICE, time_slices


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], rows_a_slice: int = ROWS_A_SLICE) -> DataFrame:
    """Left rows with ``values`` of the newest right row of the same ``by`` at or before their time, null if there is none.

    One union and one window sorted by time, so one shuffle and no join: memory doesn't grow with a key's
    rows. Of right rows at one time the one with the largest values counts; those without a time never match. Where there are more than
    ``rows_a_slice`` rows, time is cut into slices, so that a key's rows are spread over tasks; the newest
    right row of the slices before enters each slice of its key first.
    """
    packed = F.struct(*values)
    own = F.struct(*left.columns)
    none = lambda d, name: F.lit(None).cast(d.select(own if name == "l" else packed).schema[0].dataType)
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), own.alias("_l"), none(right, "r").alias("_r"))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), none(left, "l").alias("_l"), packed.alias("_r")).where("_t is not null")
    rows, keys = a.unionByName(b), list(by)
    times = left.select(F.col(left_time).alias("_t")).unionByName(right.select(F.col(right_time).alias("_t")))
    if cut := time_slices(times, "_t", rows_a_slice):
        slice_of, count = cut
        rows, keys = rows.withColumn("_slice", slice_of(F.col("_t"))), [*by, "_slice"]
        # a row a key and slice, and what each leaves to the slices up to the next one that has right rows
        last = b.withColumn("_slice", slice_of(F.col("_t"))).groupBy(*keys).agg(F.max(F.struct("_t", "_r")).alias("_last"))
        until = F.coalesce(F.lead("_slice").over(Window.partitionBy(*by).orderBy("_slice")), F.lit(count - 1))
        carried = last.withColumn("_until", until).withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, F.greatest("_until", F.col("_slice") + 1)))).where(F.col("_slice") < count)
        rows = rows.unionByName(carried.select(*by, F.col("_last._t").alias("_t"), F.lit(0).alias("_side"), none(left, "l").alias("_l"), F.col("_last._r").alias("_r"), "_slice"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def gapfill(df: DataFrame, bucket: str, width: str, by: Sequence[str], start, end) -> DataFrame:
    """The rows, and one with null values for each bucket in [start, end) that a series (by) lacks."""
    series = df.select(*by).distinct()
    wanted = series.withColumn(bucket, F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL '{width}'")))).where(F.col(bucket) < F.lit(end).cast("timestamp"))
    return wanted.join(df, [*by, bucket], "left")
