"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Rows whose (length, prefix hash) no other row has are settled by these; the others are compared by the
hash of their whole text. Every row carries that hash along, in place of its text. Groups are counted with map-side combining and the
joins back are plain equi-joins, so a group holding a third of all rows is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical byte for byte; null counts as the empty text. Of equal texts the
    row with the largest id stays. Rows repeated with the same id count in ``group_size`` and are all
    kept or all dropped; a row without an id counts too and is kept. An empty table gives an empty
    result; other columns are ignored.
    """
    doc, text = F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit(""))
    length, head, digest = F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_head"), F.sha2(text, 256).alias("text_sha256")
    # both levels are counted before any join, so that rows of a common length are never gathered
    counted = docs.select(length, head).groupBy("_len", "_head").agg(F.count("*").alias("_n"))
    lengths = counted.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    heads = counted.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_head")
    # a row is in one of the two parts, whatever its id; the digest is hashed where the text is read, and pruned where nobody wants it
    rows = docs.select(doc, length, head, digest)
    settled = rows.join(heads, ["_len", "_head"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    full = rows.join(heads, ["_len", "_head"], "left_semi").select("doc_id", "text_sha256")
    groups = full.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # joined by digest alone, so that the join has a shuffle of its own and a large group can be split
    copies = full.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return settled.unionByName(copies)
