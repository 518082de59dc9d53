"""Slices of time, so that the rows of one key are spread over tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_A_SLICE = 2_000_000


def time_slices(df: DataFrame, time: str, rows: int = ROWS_A_SLICE) -> tuple[Callable[[Column], Column], int] | None:
    """A function from times to numbered slices of equal width, and how many there are; None where one is enough.

    One pass counts the rows. Times without a zone are cut only in a session whose zone is UTC, as others
    have hours that run backwards.
    """
    kind = df.schema[time].dataType.simpleString()
    zoned = kind == "timestamp" or kind == "timestamp_ntz" and df.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"
    if not zoned and kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return None
    number = (lambda t: F.unix_micros(t.cast("timestamp")).cast("double")) if zoned else (lambda t: t.cast("double"))
    n, low, high = df.agg(F.count(time), F.min(number(F.col(time))), F.max(number(F.col(time)))).first()
    count = -(-n // rows)
    if count < 2 or not low < high:
        return None
    # in floating point, which keeps the order of times
    return (lambda t: F.least(F.floor((number(t) - F.lit(low)) * F.lit(count / (high - low))), F.lit(count - 1)).cast("int")), count
