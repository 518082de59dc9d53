"""Token counts through a digest cache.

The cache is a Parquet table partitioned by tokenizer digest, one row per content digest. Counts are
joined by digest; only the distinct contents without a stored count are encoded, and they are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import slices, small_batches

CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer_digest string"
_loaded: dict[str, object] = {}


def tokenizer_digest(kind: str, model: bytes) -> str:
    """Identifies library, version, options and model; counts stored under another digest are never used."""
    import importlib.metadata

    said = f"{kind}|{importlib.metadata.version(kind)}|plain"
    return hashlib.sha256(said.encode() + b"\0" + model).hexdigest()


def kind_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def _counter(kind: str, digest: str, model: bytes):
    """A function from texts to token counts, loaded once per Python worker."""
    if digest not in _loaded:
        if kind == "sentencepiece":
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_proto=model)
            _loaded[digest] = lambda texts: [len(ids) for ids in piece.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            other = Tokenizer.from_str(model.decode())
            other.no_truncation()
            other.no_padding()
            _loaded[digest] = lambda texts: [len(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]
    return _loaded[digest]


def _stored(spark: SparkSession, cache_path: str, digest: str) -> DataFrame:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    # writers that ran at once may both have stored a digest, with the one count that it has
    return found.where(F.col("tokenizer_digest") == digest).select("content_digest", "n_tokens").distinct()


def drop_cache(spark: SparkSession, cache_path: str) -> None:
    """Delete a cache that was made for one call; counts that are still read from it must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def token_counts(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row; whole texts, null as the empty one.

    Counts are the library's own, without added special tokens, truncation or padding. Equal texts are
    encoded once; rows with equal or null ids keep a row each. Encoding runs when this is called and
    adds the misses to ``cache_path``; a second call on the same texts encodes nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:  # a vocabulary of a fixed size, on the driver alone
        model = f.read()
    kind = kind_of(model_path)
    version = tokenizer_digest(kind, model)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn("content_digest", F.unhex(F.sha2("_text", 256)))
    plain = rows.select("doc_id", "content_digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    misses = (
        plain.groupBy("content_digest")
        .agg(F.min("doc_id").alias("_first"))
        .join(_stored(spark, cache_path, version), "content_digest", "left_anti")
        .withColumnRenamed("content_digest", "_miss")
    )
    wanted = rows.join(misses, rows["doc_id"].eqNullSafe(misses["_first"]) & (rows["content_digest"] == misses["_miss"])).select("content_digest", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(kind, version, model)
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                counts = pa.array(count(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("content_digest").slice(at, len(texts)), counts], ["content_digest", "n_tokens"])

    wanted.mapInArrow(encode, "content_digest binary, n_tokens long").withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    return plain.join(_stored(spark, cache_path, version), "content_digest").select("doc_id", "n_bytes", "n_tokens")
