"""From points with maps of tags and fields to wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lattice
from ..functions.hashing import hash_of
from ..functions.naming import distinct_columns, field_column, tag_column

_SLOT = {"boolean": "b", "bigint": "i", "double": "d", "string": "s"}


def names_and_types(points: DataFrame) -> DataFrame:
    """``measurement, kind, name, rank``: each tag, and each field with the rank of its widest type."""
    tags = points.select("measurement", F.explode(F.map_keys("tags")).alias("name")).distinct().select("measurement", F.lit("tag").alias("kind"), "name", F.lit(lattice.RANK["string"]).alias("rank"))
    ranks = F.create_map(*[F.lit(x) for t, r in lattice.RANK.items() for x in (t, r)])
    fields = points.select("measurement", F.explode("fields").alias("name", "v")).groupBy("measurement", "name").agg(F.max(ranks[F.col("v.type")]).alias("rank"))
    return tags.unionByName(fields.select("measurement", F.lit("field").alias("kind"), "name", "rank"))


def field_as(name: str, to: str) -> Column:
    """The field's value in the column's type, whatever type the point gave it; null if the point lacks it."""
    v = F.col("fields")[name]
    out = F.lit(None).cast(to)
    for t, slot in _SLOT.items():
        if lattice.RANK[t] <= lattice.RANK[to]:
            out = F.when(v["type"] == t, lattice.widen(v[slot], t, to)).otherwise(out)
    return out


def wide_rows(points: DataFrame, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """``time, tag_hash, seq`` and a column for each tag and field (name -> type) of one measurement's points; ``seq`` is their order."""
    t, f = distinct_columns(tags, tag_column), distinct_columns(list(fields), field_column)
    return points.select(
        "time",
        hash_of(F.col("tags")).alias("tag_hash"),
        F.col("ordinal").alias("seq"),
        *[F.col("tags")[k].alias(c) for k, c in t.items()],
        *[field_as(k, fields[k]).alias(c) for k, c in f.items()],
    )
