"""Materialised bucketed aggregates, refreshed by replacing the days that changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import as_utc, parse_width, time_bucket, utc_day


def bucketed(rows: DataFrame, width: str, keys: Sequence[str], values: Mapping[str, str], time: str = "time") -> DataFrame:
    """``bucket``, the keys, and for each value (name -> column) its average, and ``n`` rows."""
    return rows.groupBy(time_bucket(width, F.col(time)).alias("bucket"), *keys).agg(*[F.avg(c).alias(n) for n, c in values.items()], F.count("*").alias("n"))


class Rollup:
    """A rollup table at a path, partitioned by the day of the bucket."""

    def __init__(self, spark: SparkSession, path: str, width: str, keys: Sequence[str], values: Mapping[str, str]):
        months, micros = parse_width(width)
        if months or micros > 86_400_000_000 or 86_400_000_000 % micros:
            raise ValueError("buckets divide a day")
        self.spark, self.path, self.width, self.keys, self.values = spark, path, width, list(keys), dict(values)

    def refresh(self, rows: DataFrame, start: datetime | str, end: datetime | str) -> None:
        """Recompute the days that [start, end) touches and replace them; the filter on time reaches the scan."""
        first = as_utc(start).replace(hour=0, minute=0, second=0, microsecond=0)
        last = as_utc(end) - timedelta(microseconds=1)
        stop = last.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)
        some = rows.where((F.col("time") >= F.lit(first)) & (F.col("time") < F.lit(stop)))
        new = bucketed(some, self.width, self.keys, self.values).withColumn("dt", utc_day(F.col("bucket")))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(self.path)

    def refresh_policy(self, rows: DataFrame, now: datetime, start_offset: str = "1 hour", end_offset: str = "1 minute") -> None:
        """The window of a schedule: from start_offset to end_offset before now."""
        ago = lambda w: timedelta(microseconds=parse_width(w)[1])
        self.refresh(rows, as_utc(now) - ago(start_offset), as_utc(now) - ago(end_offset))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("dt")
