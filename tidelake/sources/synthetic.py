"""Deterministic synthetic points, for tests and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_points(spark: SparkSession, n: int, series: int, start_row: int = 0, base_ns: int = 1_700_000_000_000_000_000, step_ns: int = 1_000_000_000) -> DataFrame:
    """Row i: host h(i mod series), region r(host mod 8), value (i mod 1000) / 10, count i mod 100, time base + i steps."""
    host = F.col("id") % series
    return spark.range(start_row, start_row + n).select(
        F.col("id").alias("i"),
        F.concat(F.lit("h"), host).alias("host"),
        F.concat(F.lit("r"), host % 8).alias("region"),
        ((F.col("id") % 1000) / 10.0).alias("value"),
        (F.col("id") % 100).alias("count"),
        (F.lit(base_ns) + F.col("id") * F.lit(step_ns)).alias("ts_ns"),
    )


def synthetic_lines(spark: SparkSession, measurement: str, n: int, series: int, **options: int) -> DataFrame:
    """The same as line protocol, a line per row."""
    p = synthetic_points(spark, n, series, **options)
    return p.select(F.concat(F.lit(f"{measurement},host="), "host", F.lit(",region="), "region", F.lit(" value="), "value", F.lit(",count="), "count", F.lit("i "), "ts_ns").alias("line"))


def synthetic_stream(spark: SparkSession, rows_per_second: int, series: int) -> DataFrame:
    """An endless stream of the same points, from Spark's rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    host = F.col("value") % series
    return rate.select(F.col("timestamp").alias("time"), F.concat(F.lit("h"), host).alias("host"), F.concat(F.lit("r"), host % 8).alias("region"), ((F.col("value") % 1000) / 10.0).alias("v"), (F.col("value") % 100).alias("count"))
