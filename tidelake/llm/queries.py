"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lattice_lm, line_dedup, minhash_dedup, packing, piece_bpe, substring_dedup, token_cache, topk_search, toxicity
from .common import crc_mod, scratch_dir, write_table

TOXIC_AT = 0.3
TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    whole = vectors.select("vec_id", topk_search.scaled(F.col("embedding"), 64).alias("vector"))
    return topk_search.exact_top_k(whole.where("vec_id % 20 = 0"), whole, 20)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in tokens, counted once through a cache that goes when pack has written them."""
    cache = f"{scratch_dir(spark)}/tidelake/token-cache-{uuid.uuid4().hex}"
    counts = token_cache.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), cache)
    packed = packing.pack(counts, "n_tokens").withColumnRenamed("length", "n_tokens")
    token_cache.drop_cache(spark, cache)
    return packed


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scored = lattice_lm.score_documents(docs, ~held_out, tokenizer_path())
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own for each call: what is measured is a cold one
    cache = f"{scratch_dir(spark)}/tidelake/token-cache-{uuid.uuid4().hex}"
    counts = token_cache.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), cache)
    counts = write_table(counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT), "token-counts")
    token_cache.drop_cache(spark, cache)
    return counts


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels, ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_minhash_dedup, op4_exact_top_k, op5_piece_codec, op6_line_dedup, op7_best_fit_packing, op8_lattice_lm, op9_token_counts, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
            s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS words
                  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
            r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM s) WHERE n > 1),
            m AS (SELECT p.doc_id, p.i, word, max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last
                  FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
            k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (last IS NOT NULL AND i - last < 35) AS n_removed,
                         string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last >= 35) AS kept FROM m GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_line_dedup": r"""
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
            s AS (SELECT doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM l),
            u AS (SELECT w, len(w) AS n, min((doc_id, i)) AS at, row_number() OVER () AS id FROM s WHERE len(w) > 0 GROUP BY w),
            t AS (SELECT id, n, unnest(w) AS word FROM u),
            o AS (SELECT word, row_number() OVER (ORDER BY count(*), word) AS o FROM t GROUP BY word),
            p AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY o) AS p FROM t JOIN o USING (word)),
            c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.word = y.word AND x.id <> y.id
                  WHERE x.p <= x.n - ceil(0.8 * x.n) + 1 AND y.p <= y.n - ceil(0.8 * y.n) + 1 AND 4 * x.n <= 5 * y.n AND 4 * y.n <= 5 * x.n),
            m AS (SELECT a, min(y.at) AS at FROM c JOIN u x ON x.id = a JOIN u y ON y.id = b
                  WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n) GROUP BY a),
            e AS (SELECT u.w, least(u.at, coalesce(m.at, u.at)) AS at FROM u LEFT JOIN m ON m.a = u.id),
            k AS (SELECT doc_id, i, line, e.at IS NOT NULL AND (doc_id, i) > e.at AS gone FROM s LEFT JOIN e ON e.w = s.w),
            g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
        "op4_exact_top_k": """
            WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    }
