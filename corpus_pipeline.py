"""From raw documents to packed sequences: five stages over the documents table, each an operator of tidelake.llm.

Every stage takes what the one before it kept. All but the last return the columns of documents; a
stage that edits texts also renews ``n_chars``. The result of a stage is written and read again before
the next one, so a lost executor costs a stage at most. Empty tables pass through; rows with null
texts count as empty ones; extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import line_dedup, minhash_dedup, packing, substring_dedup, token_cache, toxicity
from tidelake.llm.common import crc_mod, release, scratch_dir
from tidelake.llm.queries import TOXIC_AT, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learns from three quarters of the labels, as op10 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    return toxicity.reject(docs, model, TOXIC_AT)


def _edited(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], text: Callable[[DataFrame], Column]) -> DataFrame:
    """The columns of docs with the texts that an operator gives; what it doesn't need rides along in one column, whatever it is called."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = operator(docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *rest).alias("rest")))
    cut = F.col("n_removed") > 0
    new = text(found)
    made = {"doc_id": F.col("doc_id"), "text": F.when(cut, new).otherwise(F.col("text")), "n_chars": F.when(cut, F.length(new).cast("long")).otherwise(F.col("rest.n_chars")) if "n_chars" in rest else None}
    return found.select(*[(made[c] if c in made else F.col("rest")[c]).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are like an earlier line; no document goes."""
    return _edited(docs, line_dedup.line_dedup, lambda found: F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the smallest id, and of rows that are alike in id and text any one."""
    kept = minhash_dedup.near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    found = rows.join(kept, F.col("_own").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_hash")))
    single = found.where("_copies = 1").select("row.*")
    return single.unionByName(found.where("_copies > 1").dropDuplicates(["_kept", "_hash"]).select("row.*"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; a text that has none stays as it is, line ends included."""
    return _edited(docs, substring_dedup.substring_dedup, lambda found: F.col("kept_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a bin; lengths are in tokens of the queries' tokenizer."""
    cache = f"{scratch_dir(spark)}/tidelake/token-cache-{uuid.uuid4().hex}"
    counts = token_cache.token_counts(docs.select("doc_id", "text"), tokenizer_path(), cache)
    packed = packing.pack(counts.select("doc_id", F.col("n_tokens").alias("length")), "length")
    token_cache.drop_cache(spark, cache)  # pack has written the lengths
    return packed


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("packing", pack)]

#: the toxicity model, the near-duplicate estimate and the packing have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/tidelake/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        release()
    return docs
