"""Relations over objects of several tiers whose column types may differ."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lattice
from ..operators.dedup import merge_columns, newest_by_seq
from ..sources.manifest import RANK, ObjectMeta, Store

FIXED = {"time": "timestamp", "tag_hash": "bigint", "seq": "bigint"}


def union_by_name(frames: Iterable[DataFrame], types: dict[str, str]) -> DataFrame:
    """All rows with the columns and types given; narrower columns are widened and missing ones null."""
    out = None
    for df in frames:
        have = dict(df.dtypes)
        extra = [c for c in df.columns if c not in types]
        cast = df.select(*[(lattice.widen(F.col(c), have[c], t) if c in have and have[c] != t else F.col(c) if c in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()], *extra)
        out = cast if out is None else out.unionByName(cast)
    if out is None:
        raise ValueError("no relation")
    return out


def lattice_types(frames: Iterable[DataFrame]) -> dict[str, str]:
    """Every column of the frames with the widest of its types; types outside the lattice must agree."""
    out: dict[str, str] = {}
    for df in frames:
        for c, t in df.dtypes:
            if c in out and out[c] != t:
                if not {out[c], t} <= lattice.RANK.keys():
                    raise ValueError(f"{c} is {out[c]} and {t}")
                t = lattice.widest([out[c], t])
            out[c] = t
    return out


def empty(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in types.items())))


def scan(store: Store, objects: Iterable[ObjectMeta], columns: dict[str, str], with_cols: bool = False) -> DataFrame:
    """Rows of the objects in the table's types, with ``_rank`` of their tier (and the columns they wrote, ``_cols``).

    Objects of one schema and tier are one scan, so there are as many scans as schemas and not as objects.
    """
    types = FIXED | columns
    groups: dict[tuple, list[ObjectMeta]] = defaultdict(list)
    for o in objects:
        folded = o.columns.get("_cols") == "array<string>"
        groups[o.kind, folded, tuple(sorted((c, t) for c, t in o.columns.items() if c != "_cols"))].append(o)
    frames = []
    for (kind, folded, own), some in sorted(groups.items()):
        schema = FIXED | dict(own) | ({"_cols": "array<string>"} if folded else {})
        df = store.spark.read.schema(T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in schema.items()))).parquet(*[store.path(o.object_key) for o in some])
        df = df.withColumn("_rank", F.lit(RANK[kind]))
        if not with_cols:
            df = df.drop("_cols")
        elif not folded:
            df = df.withColumn("_cols", F.array(*[F.lit(c) for c, _ in own if c.startswith("f_")]).cast("array<string>"))
        frames.append(df)
    if not frames:
        return empty(store.spark, types | {"_rank": "int"} | ({"_cols": "array<string>"} if with_cols else {}))
    return union_by_name(frames, types)


def hot_relation(store: Store, objects: Iterable[ObjectMeta], columns: dict[str, str]) -> DataFrame:
    """The hot tier: writes merged column by column. Shows ``seq``."""
    fields = [c for c in columns if c.startswith("f_")]
    rows = merge_columns(scan(store, objects, columns, with_cols=True), fields)
    return rows.select(*FIXED, *columns)


def federated_relation(hot: DataFrame | None, store: Store, cold: Iterable[ObjectMeta], columns: dict[str, str]) -> DataFrame:
    """Hot and cold: the newest whole row of each key; hides ``seq``."""
    rows = scan(store, cold, columns)
    if hot is not None:
        rows = rows.unionByName(hot.withColumn("_rank", F.lit(RANK["hot"])))
    return newest_by_seq(rows).drop("seq", "_rank")
