"""The registered queries' rows against plain Python on a small fixture."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tidelake.llm.minhash_dedup import near_duplicates
from tidelake.llm.queries import TOKEN_LIMIT, op2_exact_dedup, op7_best_fit_packing, op9_token_counts, queries, tokenizer_path


def test_exact_dedup_keeps_rows_with_null_and_repeated_ids(spark, tmp_path):
    head = "p" * 300
    rows = [(None, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "c"), (3, head + "x"), (3, head + "y"), (4, head + "x"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op2_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i is None or i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A few documents with nulls, copies and one longer than any bin."""
    base = tmp_path_factory.mktemp("texts")
    rows = [(0, "a clean text"), (1, None), (2, ""), (3, " \t\n"), (4, "one two  three\nfour"), (5, "a clean text"), (6, "long words " * 4500), (7, "é 日本 x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    return str(base), dict(rows)


def test_op7_packs_every_token(spark, texts):
    import sentencepiece

    base, docs = texts
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = op7_best_fit_packing(spark, base).collect()
    total, bins = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert dict(total) == {i: len(piece.encode(t or "")) for i, t in docs.items()}
    assert all(sum(r.n_tokens for r in own) == own[0].bin_load <= own[0].capacity for own in bins.values())


def test_op9_counts_every_text(spark, texts):
    import sentencepiece

    base, docs = texts
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = []
    for i, t in docs.items():
        n = len(piece.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > TOKEN_LIMIT))
    assert sorted(map(tuple, op9_token_counts(spark, base).collect())) == sorted(want)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use themselves
CLASHING = "_key _id _text _gone _row _g _h node own set spans word words n_words n_lines n_removed n_tokens kept kept_text length band".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty, very long, equal and repeated rows, and columns of the operators' own names."""
    base = tmp_path_factory.mktemp("odd")
    long_ = " ".join(f"w{i % 5000}" for i in range(60_000))
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (None, "null id"), (None, "null id"), (None, None), (2, None), (3, ""), (4, " \t\r\n"), (5, long_), (6, "日" * 30_000), (7, "x" * 30_000), (8, "a b c d e g\n" * 3000), (9, None)]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None if k % 2 else 1) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.select("*", *[F.lit(777).alias(c) for c in CLASHING]).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 1, 1), (8, 0, None), (5, 1, 1), (5, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [float("inf"), 0.0]), (20, [0.5, -0.5])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).write.parquet(f"{base}/embeddings.parquet")
    return str(base), [i for i, _ in texts]


@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_rows_have_a_result_each(spark, odd, name):
    base, ids = odd
    got = queries()[name](spark, base)
    if name == "op4_exact_top_k":
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == [(0, 1, 1, 64 * 64 * 5), (0, 2, 1, 64 * 64 * 5), (0, 3, 20, -64 * 32), (20, 1, 0, -64 * 32), (20, 2, 1, -64 * 32), (20, 3, 1, -64 * 32)]
    elif name == "op7_best_fit_packing":
        assert got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).where("doc_id = 5").first().n > 60_000
        assert Counter(r.doc_id for r in got.where("piece = 0").collect()) == Counter(ids)
    else:
        assert Counter(r.doc_id for r in got.collect()) == Counter(ids)


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables_give_empty_results(spark, tmp_path, odd, name):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_near_duplicates_have_the_exact_classes(spark):
    """Against all pairs that share a shingle; recall counts similar pairs in one class."""
    from test_llm_operators import brute_similarity, counts

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bags = {r.doc_id: counts(r.text) for r in docs.collect()}
    holders = defaultdict(list)
    for i, bag in bags.items():
        for gram in bag:
            holders[gram].append(i)
    shared = Counter(pair for own in holders.values() for pair in itertools.combinations(sorted(own), 2))
    sizes = {i: len(b) for i, b in bags.items()}
    # at a similarity of 0.8 more than half of the larger one's shingles are shared
    pairs = [(i, j) for (i, j), n in shared.items() if 2 * n >= max(sizes[i], sizes[j]) and brute_similarity(bags[i], bags[j]) >= 0.8]
    found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    hit = sum(found[i] == found[j] for i, j in pairs)
    print(f"near duplicates: {hit} of {len(pairs)} similar pairs share a class")
    assert len(pairs) > 50 and hit >= 0.98 * len(pairs)
    # nothing is joined that no chain of similar pairs joins
    up = {i: i for i in bags}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    empty = [i for i in bags if not bags[i]]
    assert all(find(i) == find(found[i]) for i in bags if i not in empty)
