"""Newest version per key: whole rows, or column by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("time", "tag_hash")


def key_columns(df: DataFrame, key: Sequence[str] = KEY) -> list[str]:
    """The key and all tag columns. Tags are constant within a key, so the groups are the same, and a
    filter on a tag then passes below the window or aggregate to the scan."""
    return [*key, *[c for c in df.columns if c.startswith("t_") and c not in key]]


def newest_rows(df: DataFrame, order: Sequence[Column], key: Sequence[str] = KEY) -> DataFrame:
    """Of each key the first row in ``order``, whole. Spark cuts each task's rows to one a key before the shuffle."""
    w = Window.partitionBy(*key_columns(df, key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def newest_by_seq(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Highest ``seq`` wins; of equal ones the higher ``_rank`` (hot before export, compacted and staging), if there is that column."""
    order = [F.desc("seq"), *([F.desc("_rank")] if "_rank" in df.columns else [])]
    return newest_rows(df, order, key)


def merge_columns(df: DataFrame, fields: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Upserts replayed: each field has its value from the newest row that wrote the field, a null included.

    ``_cols`` lists the columns that a row wrote; a field that is not in it is left as it was. ``seq`` is
    the newest. The aggregates combine before the shuffle.
    """
    versions = [F.expr(f"max_by(`{f}`, seq) FILTER (WHERE array_contains(_cols, '{f}'))").alias(f) for f in fields]
    return df.groupBy(*key_columns(df, key)).agg(F.max("seq").alias("seq"), *versions)
