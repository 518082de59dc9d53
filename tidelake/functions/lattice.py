"""Column types: inferred from values, widened along boolean < bigint < double < string, never narrowed."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("boolean", "bigint", "double", "string")
RANK = {t: r for r, t in enumerate(TYPES)}


def infer(value: object) -> str:
    """The narrowest type of a parsed value; booleans are no integers."""
    for kind, t in ((bool, "boolean"), (int, "bigint"), (float, "double")):
        if isinstance(value, kind):
            return t
    return "string"


def widest(types: Iterable[str]) -> str:
    """The least type that holds all of them; unknown types are text."""
    return TYPES[max((RANK.get(t, 3) for t in types), default=0)]


def coerce(value: object, to: str) -> object:
    """A single value in a column's type: numbers truncate to integers, text is read as a number, anything has a text."""
    if value is None:
        return None
    if to == "string":
        return str(value)
    if to == "double":
        return float(value)
    if to == "bigint":
        return int(value) if isinstance(value, (bool, int, float)) else int(str(value))
    return bool(value) if isinstance(value, (bool, int, float)) else str(value).lower() in {"t", "true", "1"}


@F.arrow_udf(T.StringType())
def _float_text(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else repr(x) for x in v.to_pylist()], pa.string())


def widen(value: Column, of: str, to: str) -> Column:
    """The column in a wider type. Booleans reach numbers through integers; text forms are Python's (True, 1.0, 1e+20)."""
    if of == to:
        return value
    if RANK[to] < RANK[of]:
        raise ValueError(f"{of} is never narrowed to {to}")
    if to == "string":
        if of == "boolean":
            return F.when(value, F.lit("True")).when(~value, F.lit("False"))
        return _float_text(value) if of == "double" else value.cast("string")
    return value.cast("bigint").cast(to) if of == "boolean" else value.cast(to)


def read_text(value: Column, to: str) -> Column:
    """Text in a column's type, by the rules of ``coerce``; text that isn't such a value is null."""
    if to == "boolean":
        return F.lower(value).isin("t", "true", "1")
    return value if to == "string" else F.trim(value).try_cast(to)


def widening_sql(column: str, of: str, to: str) -> str:
    """The cast as SQL text, for a schema change that is logged or shown."""
    name = "`" + re.sub("`", "``", column) + "`"
    if of == "boolean" and to in ("bigint", "double"):
        return f"CAST(CAST({name} AS INT) AS {to.upper()})"
    return f"CAST({name} AS {to.upper()})"
