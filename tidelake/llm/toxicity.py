"""Toxicity by maximum-scoring segments.

1. Each token's log-odds between toxic and other labelled documents, with a Dirichlet prior in
   proportion to the token's share of both; tokens whose log-odds are not significant score zero.
2. A passage is a run of tokens; each token adds its log-odds less a constant, so a neutral token
   costs a little. One linear scan finds all maximal-scoring passages of a document.
3. Karlin-Altschul statistics (lambda solves sum p exp(lambda s) = 1 over the tokens of documents that
   are not toxic) turn a passage's score into nats above what a document of that length has by chance;
   those beyond a significance level are the toxic passages.
4. The best passage and the sum over the significant ones become a probability by logistic regression.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, small_batches, words, write_table

TRAIN_ROWS = 20_000
FOLDS = 3
PRIOR = 20_000.0
Z_LEAST = 2.5


@dataclass
class ToxicModel:
    """Log-odds of the significant tokens of at most ``TRAIN_ROWS`` documents, and a few numbers."""

    odds: dict[str, float] = field(default_factory=dict)
    shift: float = 0.4
    lam: float = 1.0
    log_k: float = 0.0
    level: float = math.log(20.0)
    weights: tuple[float, float, float] = (-3.0, 0.0, 0.0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-case words without ASCII punctuation at their ends; offsets of the rows."""
    offsets, flat = words(pc.utf8_lower(texts))
    return offsets, pc.utf8_trim(flat, string.punctuation)


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in order, in linear time.

    The tokens between two positive ones are one gap. The stack holds the candidates with the sums
    before and after each; a new one reaches back as long as that raises its score.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest one below with a smaller sum before
    for p in places.tolist():
        start, before, after = p, float(total[p]), float(total[p + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append([start, p + 1, before, after, j])
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, y - x) for a, b, x, y, _ in stack]


def log_odds(counts: dict[str, tuple[int, int]], totals: tuple[int, int], prior: float = PRIOR, z_least: float = Z_LEAST) -> dict[str, float]:
    """Token -> log-odds of the toxic class, of the tokens whose log-odds differ from zero by z_least deviations."""
    n1, n0 = totals
    out = {}
    for t, (y1, y0) in counts.items():
        if not y1 + y0:  # seen in other rows only
            continue
        a = prior * (y1 + y0) / max(1, n1 + n0)
        d = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        z = d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if abs(z) >= z_least:
            out[t] = max(-3.0, min(6.0, d))
    return out


def _score_table(model: ToxicModel, flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    table = np.fromiter((model.odds.get(t, 0.0) for t in coded.dictionary.to_pylist()), np.float64, len(coded.dictionary))
    return (table - model.shift)[coded.indices.to_numpy(zero_copy_only=False)]


def features(model: ToxicModel, texts: pa.Array) -> Iterator[tuple[float, float, list[tuple[int, int, float]]]]:
    """Per text: nats of the best passage, the log of one plus those of the significant ones, and these."""
    offsets, flat = tokens(texts)
    scores = _score_table(model, flat)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        chance = math.log(max(1, b - a)) + model.log_k
        found = [(s, e, model.lam * x - chance) for s, e, x in passages(scores[a:b])]
        toxic = [x for x in found if x[2] >= model.level]
        yield max((x[2] for x in found), default=-chance), math.log1p(sum(x[2] for x in toxic)), toxic


def _lambda(s: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; the mean of s is negative and some s positive."""
    low, high = 1e-6, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method on standardised columns, each step halved until it lowers the penalised loss: classes that can be told apart by a line don't make it diverge."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = ridge * np.array([1e-3, *np.ones(x.shape[1])])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (penalty * w * w).sum() / 2
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8 or size <= 1e-6:
            break
    slopes = w[1:] / scale
    return (float(w[0] - (slopes * mean).sum()), *(float(v) for v in slopes))


def chosen_labels(labels: DataFrame, train_on: Column, id_col: str, max_rows: int) -> list[tuple[int, int]]:
    """At most ``max_rows`` labelled ids that ``train_on`` allows, with their label: those with the smallest hashes.

    Where there are more, only hashes under a bound that leaves about ``max_rows`` of them are sorted.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .where(train_on)
        .withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    )
    n = known.count()
    if n > 2 * max_rows:
        known = known.where(F.col("_h") < F.lit(int(2**63 * (1.5 * max_rows / n))))
    return [(r.doc_id, int(bool(r.y))) for r in known.orderBy("_h", "doc_id").limit(max_rows).collect()]


def _significant(y1: Column, y0: Column, n1: Column, n0: Column, prior: float, z_least: float) -> Column:
    """Whether log_odds() keeps a token."""
    a = F.lit(prior) * (y1 + y0) / F.greatest(n1 + n0, F.lit(1))
    d = F.log((y1 + a) / (n1 + F.lit(prior) - y1 - a)) - F.log((y0 + a) / (n0 + F.lit(prior) - y0 - a))
    return (y1 + y0 > 0) & (F.abs(d / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))) >= z_least * 0.999)


def _fitted(counts: dict[str, tuple[int, int]], totals: tuple[int, int]) -> ToxicModel:
    """Log-odds, and the lambda of the tokens of the other class; without a usable one the default model."""
    odds = log_odds(counts, totals)
    model = ToxicModel()
    n0 = max(1, totals[1])
    background = {t: counts[t][1] for t in odds}
    s = np.array([odds[t] for t in background] + [0.0]) - model.shift
    p = np.array([*background.values(), max(0, n0 - sum(background.values()))]) / n0
    if not (s[:-1] > 0).any() or (s * p).sum() >= 0:
        return model
    return ToxicModel(odds, lam=min(8.0, _lambda(s, p)))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Fit on at most ``max_rows`` labelled rows, the smallest by a hash of their id, where ``train_on`` holds.

    A document with several labels is toxic if one of them says so; null labels and ids are left out.
    The chance level and the weights of the logistic regression come from documents that the log-odds
    they are measured with have not seen: the rows are dealt into ``FOLDS``, each measured by the others'
    log-odds. The final log-odds use all rows, and every token of theirs that is significant.
    Without any labelled row of either class the model is the default one, which calls nothing toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = chosen_labels(labels, train_on, id_col, max_rows)
    if len({y for _, y in chosen}) < 2:
        return ToxicModel()
    # folds hold a like share of both classes
    seen = [0, 0]
    dealt = []
    for i, y in chosen:
        dealt.append((i, y, seen[y] % FOLDS))
        seen[y] += 1
    # at most max_rows small rows, whatever the corpus
    keys = F.broadcast(spark.createDataFrame(dealt, "_label_of long, _y int, _fold int"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(keys, F.col("_id") == F.col("_label_of")).select("_y", "_fold", "_text")
    columns = [f"y{y}_{f}" for f in range(FOLDS) for y in (1, 0)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_fold"))
            for at, texts in slices(batch.column("_text")):
                offsets, flat = tokens(texts)
                sizes = np.diff(offsets)
                y, f = (np.repeat(x[at : at + len(texts)], sizes) for x in (label, fold))
                coded = flat.dictionary_encode()
                index, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
                some = [pa.array(np.bincount(index[(y == k) & (f == j)], minlength=n)) for j in range(FOLDS) for k in (1, 0)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *some], ["token", *columns])

    counted = rows.mapInArrow(count, "token string, " + ", ".join(f"{c} long" for c in columns)).groupBy("token").agg(*[F.sum(c).alias(c) for c in columns])
    with scratch():
        counted = write_table(counted, "toxic-counts")
        totals = [int(x or 0) for x in counted.agg(*[F.sum(c) for c in columns]).first()]

        def of(values, left_out: int | None, y: int):
            """Counts of class y in all folds but one."""
            return sum((values[2 * f + 1 - y] for f in range(FOLDS) if f != left_out), start=0)

        wanted = F.lit(False)
        for f in (None, *range(FOLDS)):
            own = [F.col(c) for c in columns]
            wanted |= _significant(of(own, f, 1), of(own, f, 0), F.lit(of(totals, f, 1)), F.lit(of(totals, f, 0)), PRIOR, Z_LEAST)
        # of the tokens of max_rows documents, those that are significant in a fold
        got = [(r.token, list(r)[1:]) for r in counted.where(wanted).collect()]
    fit = lambda f: _fitted({t: (of(x, f, 1), of(x, f, 0)) for t, x in got}, (of(totals, f, 1), of(totals, f, 0)))
    models = [fit(f) for f in range(FOLDS)]
    model = fit(None)
    if not model.odds:
        return model
    shipped = spark.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row's passages by the model that has not seen it, in nats before the chance level is taken off."""
        for batch in batches:
            label, fold = batch.column("_y"), batch.column("_fold").to_pylist()
            for at, texts in slices(batch.column("_text")):
                offsets, flat = tokens(texts)
                tables = {f: _score_table(shipped.value[f], flat) for f in {*fold[at : at + len(texts)]}}
                found = [[shipped.value[f].lam * x for _, _, x in passages(tables[f][a:b])] for f, a, b in zip(fold[at : at + len(texts)], offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([label.slice(at, len(texts)), pa.array(np.diff(offsets)), pa.array(found, pa.list_(pa.float64()))], ["y", "n", "nats"])

    with scratch():
        measured = write_table(rows.mapInArrow(measure, "y int, n long, nats array<double>"), "toxic-measured")
        chance = F.log(F.greatest("n", F.lit(1)).cast("double"))
        # a Gumbel variable's mean is 0.5772 above its mode, which gives K
        level = measured.where((F.col("y") == 0) & (F.size("nats") > 0)).agg(F.avg(F.array_max("nats") - chance)).first()[0]
        model.log_k = (level if level is not None else 0.5772) - 0.5772
        above = F.transform("nats", lambda x: x - F.col("chance"))
        toxic = F.aggregate(F.filter(above, lambda x: x >= model.level), F.lit(0.0), lambda s, x: s + x)
        described = measured.withColumn("chance", chance + F.lit(model.log_k)).select("y", F.coalesce(F.array_max(above), -F.col("chance")).alias("best"), F.log1p(toxic).alias("total"))
        rows_ = described.collect()  # max_rows rows of three numbers
    model.weights = _logistic(np.array([(r.best, r.total) for r in rows_]), np.array([r.y for r in rows_], float))
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` of each row; a passage is (first word, end word, nats above chance).

    Whole texts, null as the empty one; a text without words has no passage. Words are counted as in
    the text. One scan of the documents without a shuffle; the model has a bounded size.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    w0, w1, w2 = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                best, found = [], []
                for a, b, p in features(shipped.value, texts):
                    best.append(1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * a + w2 * b)))))
                    found.append([{"start": s, "stop": e, "nats": x} for s, e, x in p])
                shape = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("nats", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(best, pa.float64()), pa.array(found, shape)], ["doc_id", "score", "passages"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start: long, stop: long, nats: double>>")


def reject(docs: DataFrame, model: ToxicModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text scores under the threshold; null texts count as empty.

    Texts are scored where they are read; nothing is joined or shuffled.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    w0, w1, w2 = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            for _, texts in slices(batch.column(text_col)):
                good += [1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * a + w2 * b)))) < threshold for a, b, _ in features(shipped.value, texts)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
