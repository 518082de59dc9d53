"""The identity of a series: a 63-bit BLAKE2b hash of its sorted tags; no tags hash to 0."""

from __future__ import annotations

from collections.abc import Mapping
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: between key and value, and between pairs
_PAIR, _NEXT = "\x1e", "\x1f"


def tag_hash(tags: Mapping[str, str]) -> int:
    return text_hash(_NEXT.join(f"{k}{_PAIR}{tags[k]}" for k in sorted(tags))) if tags else 0


def text_hash(canonical: str) -> int:
    if not canonical:
        return 0
    return int.from_bytes(blake2b(canonical.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1)


def canonical_tags(tags: Column) -> Column:
    """The text that is hashed, made in the JVM; null and empty maps make the empty text."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(_PAIR), e["value"]))
    return F.coalesce(F.array_join(pairs, _NEXT), F.lit(""))


@F.arrow_udf(T.LongType())
def _hash_texts(texts: pa.Array) -> pa.Array:
    coded = texts.dictionary_encode()  # a batch has far fewer series than points
    return pa.array([text_hash(t) for t in coded.dictionary.to_pylist()], pa.int64()).take(coded.indices)


def hash_of(tags: Column) -> Column:
    """The hash of each row's tag map."""
    return _hash_texts(canonical_tags(tags))


def with_hash_of_columns(df: DataFrame, tags: Mapping[str, str], name: str = "tag_hash") -> DataFrame:
    """Adds the hash of the tags held in columns (tag -> column); null ones are absent."""
    filled = F.map_filter(F.create_map(*[x for t, c in tags.items() for x in (F.lit(t), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if tags else F.lit(None).cast("map<string,string>")
    return df.withColumn(name, hash_of(filled))
