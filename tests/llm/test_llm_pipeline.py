from __future__ import annotations

import os
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import toxicity
from tidelake.llm.common import crc_mod
from tidelake.llm.queries import TOXIC_AT, tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Few documents, with nulls, copies and an extra column."""
    base = tmp_path_factory.mktemp("sf")
    line = " ".join(f"word{i}" for i in range(60))
    texts = ["a clean text of its own", None, "", line, line, line + " end", "you idiot trash loser", f"first {line} last", "x\ny"]
    rows = [(i, t, "en", "s", len(t or ""), i * 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages_keep_the_columns(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept[0] == "a clean text of its own" and kept[8] == "x\ny"
    assert 4 not in kept or not kept[4]  # a copy goes with its lines
    assert all(r.n_chars == len(r.text or "") for r in docs.collect())


def test_each_stage_against_plain_python(spark, tmp_path):
    """Kept ids and texts of every stage on its own input; columns with the operators' names ride along."""
    from test_llm_operators import brute_classes, brute_lines, brute_repeats

    rng = random.Random(27)
    vocabulary = [f"w{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, near = line(60), line(90)
    texts = ["\n".join(line(rng.randint(5, 30)) for _ in range(3)) for _ in range(12)]
    texts += [f"{line(8)} {passage} {line(9)}", f"{passage}\n{line(12)}", near, near.replace(" ", "  ", 1) + " end", texts[0], None, "", texts[1].split("\n")[1] + "\nits own line"]
    texts += [line(10) + " idiot trash loser idiot trash" for _ in range(6)]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, i, i, i, i) for i, t in enumerate(texts)]
    rows += [rows[3]]  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key int, _gone int, n_removed int, rest int")
    spark.createDataFrame([(i, 1, int(i >= 20)) for i in range(len(texts)) if i % 8], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, docs):
        stages[name](spark, docs, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted(out.collect(), key=lambda r: r.doc_id)
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r["_key"] == r["_gone"] == r["n_removed"] == r["rest"] == r.doc_id for r in got)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        return out, got

    held = sorted(docs.collect(), key=lambda r: r.doc_id)
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), crc_mod(F.col("doc_id"), 4) != 2)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    docs, got = run("toxicity", docs)
    assert got == [r for r in held if scores[r.doc_id] < TOXIC_AT]

    # identical rows lose the same lines, so that the repeated row counts once
    before = {r.doc_id: r.text for r in got}
    docs, got = run("line_dedup", docs)
    want = dict(zip(before, brute_lines(list(before.values()))))
    assert [(r.doc_id, r.text) for r in got] == [(i, want[i]) for i in sorted([*before, *([3] if 3 in before else [])])]

    before = {r.doc_id: r.text for r in got}
    ids = list(before)
    docs, got = run("near_dedup", docs)
    classes = brute_classes(list(before.values()))
    assert [r.doc_id for r in got] == [ids[k] for k in range(len(ids)) if classes[k] == k]

    before = {r.doc_id: r.text for r in got}
    docs, got = run("substring_dedup", docs)
    for r, (_, removed, kept) in zip(got, brute_repeats(list(before.values()))):
        assert r.text == (kept if removed else before[r.doc_id])

    before = {r.doc_id: r.text for r in got}
    _, got = run("packing", docs)
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert dict(total) == {i: len(piece.encode(t or "")) for i, t in before.items()}


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "bin_id", "capacity"} <= set(out.columns) and out.count() > 0


def test_empty(spark, small, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_all_documents_end_in_a_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    ids = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    assert out.join(ids, "doc_id", "left_anti").count() == 0
    assert out.where("bin_id IS NOT NULL").groupBy("bin_id").agg({"length": "sum", "capacity": "max"}).where("`sum(length)` > `max(capacity)`").count() == 0
