"""Document likelihood under a unigram model over subword lattices.

The pieces of an existing vocabulary weight all segmentations of a word; the forward recursion in log
space sums them, so a word's probability is the marginal over its segmentations, and a document's the
product over its words and one end. The vocabulary gives merge ranks; a piece starts at the Zipf
weight of its rank, and ``ROUNDS`` rounds of expectation over the training words re-estimate it.
A character without a piece is spelled by its bytes.

Words are few against tokens: counts, expectations and likelihoods are made once for each distinct
word. The most frequent words travel to the documents as a table of bounded size; the other tokens
meet their words in an equi-join whose keys are all rarer than those. Words are worked on by length,
many at once; a long one (text without spaces) goes through the recursion alone, in blocks of
characters that hand on the forward sums, so that its time and memory are linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix64, scratch, slices, small_batches, words, write_table

HEAD_WORDS = 100_000
ROUNDS = 3
#: longer words are worked on one at a time, in blocks of characters
LONG_WORD = 512
BLOCK = 4096
MARK = "▁"
SMOOTH = 0.1
COPIES = 1024
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_pieces(model_path: str) -> list[tuple[str, float]]:
    """The vocabulary's normal pieces and their scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(model_path, "rb") as f:
        spec.ParseFromString(f.read())
    return [(p.piece, p.score) for p in spec.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL]


@dataclass
class Lattice:
    """Piece hashes in order, natural log-probabilities, that of a fallback byte and of the end."""

    hashes: np.ndarray
    sizes: np.ndarray
    log_p: np.ndarray
    log_byte: float
    log_end: float

    @property
    def longest(self) -> int:
        return int(self.sizes.max(initial=1))


def _char_hash(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def start(pieces: list[tuple[str, float]]) -> Lattice:
    """Zipf weights by rank of the given scores."""
    h = np.array([gram_hashes(_char_hash(np.array([ord(c) for c in p])), len(p))[0] for p, _ in pieces], np.uint64)
    rank = np.empty(len(pieces))
    rank[np.argsort([-s for _, s in pieces], kind="stable")] = np.arange(len(pieces))
    p = 1 / (rank + 10.0)
    order = np.argsort(h)
    log_p = np.log(p / p.sum() * 0.98)[order]
    return Lattice(h[order], np.array([len(x) for x, _ in pieces])[order], log_p, float(np.log(0.01 / 256)), float(np.log(0.01)))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Larger batches: words are worked on by length, which pays with many of each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of the words of each length, in blocks of bounded size."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts):
        if not len(places):
            continue
        n = int(sizes[places[0]])
        step = max(1, 200_000 // n)
        for a in range(0, len(places), step):
            part = places[a : a + step]
            codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, codes.reshape(len(part), n)


def _edges(codes: np.ndarray, of: Lattice) -> dict[tuple[int, int], np.ndarray]:
    """(start, size) -> index of the piece there, or -1; only pairs where some word has a piece."""
    m, n = codes.shape
    flat = _char_hash(codes).ravel()
    out = {}
    for size in range(1, min(n, of.longest) + 1):
        h = gram_hashes(flat, size)
        h = np.concatenate([h, np.zeros(size - 1, np.uint64)]).reshape(m, n)[:, : n - size + 1]
        at = np.minimum(np.searchsorted(of.hashes, h), len(of.hashes) - 1)
        at = np.where((of.hashes[at] == h) & (of.sizes[at] == size), at, -1)
        for i in np.flatnonzero((at >= 0).any(axis=0)).tolist():
            out[i, size] = at[:, i]
    return out


def _fallback(codes: np.ndarray, of: Lattice) -> np.ndarray:
    """Log-probability of each character spelled in bytes."""
    return of.log_byte * (1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))


def forward(codes: np.ndarray, of: Lattice, edges: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log marginal of all prefixes (one more than there are characters), and the steps in bytes, -inf where a piece is one character."""
    m, n = codes.shape
    spelled = _fallback(codes, of)
    for i in range(n):
        if (i, 1) in edges:
            spelled[edges[i, 1] >= 0, i] = -np.inf
    a = np.full((m, n + 1), -np.inf)
    a[:, 0] = 0
    for j in range(1, n + 1):
        total = a[:, j - 1] + spelled[:, j - 1]
        for size in range(1, min(j, of.longest) + 1):
            e = edges.get((j - size, size))
            if e is not None:
                total = np.logaddexp(total, np.where(e >= 0, a[:, j - size] + of.log_p[e], -np.inf))
        a[:, j] = total
    return a, spelled


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum())) if np.isfinite(top) else float(top)


def _block_steps(codes: np.ndarray, at: int, to: int, of: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For steps that end after the characters at..to of a long word: piece index and log-probability by size less one, and the log-probability and number of bytes of one character spelled."""
    first = max(0, at - of.longest + 1)
    flat = _char_hash(codes[first:to])
    index = np.full((to - at, of.longest), -1)
    for size in range(1, of.longest + 1):
        h = gram_hashes(flat, size)  # h[k]: the characters first + k .. first + k + size
        ends = np.arange(len(h)) + first + size - 1
        found = np.minimum(np.searchsorted(of.hashes, h), len(of.hashes) - 1)
        found = np.where((of.hashes[found] == h) & (of.sizes[found] == size), found, -1)
        index[ends[ends >= at] - at, size - 1] = found[ends >= at]
    steps = np.where(index >= 0, of.log_p[index], -np.inf)
    own = codes[at:to]
    n_bytes = 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)
    return index, steps, np.where(index[:, 0] >= 0, -np.inf, of.log_byte * n_bytes), n_bytes


def _long_forward(codes: np.ndarray, of: Lattice) -> np.ndarray:
    """Log marginals of all prefixes of one word."""
    n, m = len(codes), of.longest
    a = np.full(n + m, -np.inf)  # m - 1 places before the empty prefix, which no step reaches
    a[m - 1] = 0.0
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        _, steps, spelled, _ = _block_steps(codes, at, to, of)
        steps[:, 0] = np.logaddexp(steps[:, 0], spelled)
        back = steps[:, ::-1]  # from the longest step to the shortest, as the prefixes lie
        for k in range(to - at):
            j = at + k
            a[j + m] = _log_sum(a[j : j + m] + back[k])
    return a[m - 1 :]


def _long_expected(codes: np.ndarray, of: Lattice, weight: float, pieces: np.ndarray) -> float:
    """Add the expected number of each piece in one word to ``pieces``; returns that of fallback bytes."""
    n, m = len(codes), of.longest
    a = np.concatenate([np.full(m - 1, -np.inf), _long_forward(codes, of)])
    z = a[-1]
    b = np.full(n + 1, -np.inf)  # filled from the end: what is left after each prefix
    b[n] = 0.0
    spelled_bytes = 0.0
    for to in range(n, 0, -BLOCK):
        at = max(0, to - BLOCK)
        index, steps, spelled, n_bytes = _block_steps(codes, at, to, of)
        for j in range(to, at, -1):
            k = j - 1 - at
            by_size = steps[k] + b[j]
            spell = spelled[k] + b[j]
            starts = a[j - 1 : j + m - 1][::-1]
            with np.errstate(under="ignore"):
                share = np.exp(starts + by_size - z)
                some = share > 0
                np.add.at(pieces, index[k][some], share[some] * weight)
                spelled_bytes += float(np.exp(starts[0] + spell - z)) * weight * int(n_bytes[k])
            by_size[0] = np.logaddexp(by_size[0], spell)
            low = max(0, j - m)
            b[low:j] = np.logaddexp(b[low:j], by_size[: j - low][::-1])
    return spelled_bytes


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_log_p(texts: list[str], of: Lattice) -> np.ndarray:
    """Natural log of each word's probability, summed over all its segmentations."""
    out = np.zeros(len(texts))
    short = [i for i, t in enumerate(texts) if len(t) <= LONG_WORD]
    with np.errstate(invalid="ignore"):
        for i, t in enumerate(texts):
            if len(t) > LONG_WORD:
                out[i] = _long_forward(_codes(MARK + t), of)[-1]
        where = np.array(short, np.int64)
        for places, codes in _groups([MARK + texts[i] for i in short]):
            out[where[places]] = forward(codes, of, _edges(codes, of))[0][:, -1]
    return out


def expected(texts: list[str], counts: np.ndarray, of: Lattice) -> tuple[np.ndarray, float]:
    """Expected number of each piece, and of fallback bytes, in the words."""
    pieces, byte_total = np.zeros(len(of.hashes)), 0.0
    long_ = [i for i, t in enumerate(texts) if len(t) > LONG_WORD]
    with np.errstate(invalid="ignore"):
        for i in long_:
            byte_total += _long_expected(_codes(MARK + texts[i]), of, float(counts[i]), pieces)
        if long_:
            short = [i for i, t in enumerate(texts) if len(t) <= LONG_WORD]
            texts, counts = [texts[i] for i in short], np.asarray(counts)[short]
        for places, codes in _groups([MARK + t for t in texts]):
            edges = _edges(codes, of)
            a, spelled = forward(codes, of, edges)
            m, n = codes.shape
            b = np.full((m, n + 1), -np.inf)
            b[:, n] = 0
            z = a[:, n]
            weight = counts[places]
            n_bytes = _fallback(codes, of) / of.log_byte
            for i in range(n - 1, -1, -1):
                step = b[:, i + 1] + spelled[:, i]
                byte_total += float((np.exp(np.where(np.isfinite(step), a[:, i] + step - z, -np.inf)) * weight * n_bytes[:, i]).sum())
                total = step
                for size in range(1, min(n - i, of.longest) + 1):
                    e = edges.get((i, size))
                    if e is not None:
                        went = np.where(e >= 0, b[:, i + size] + of.log_p[e], -np.inf)
                        some = np.flatnonzero(np.isfinite(went) & np.isfinite(a[:, i]))
                        np.add.at(pieces, e[some], np.exp(a[some, i] + went[some] - z[some]) * weight[some])
                        total = np.logaddexp(total, went)
                b[:, i] = total
    return pieces, byte_total


def reestimated(of: Lattice, pieces: np.ndarray, n_bytes: float, ends: float) -> Lattice:
    """Probabilities in proportion to expected numbers, smoothed."""
    total = pieces.sum() + n_bytes + ends + SMOOTH * (len(pieces) + 257)
    return Lattice(of.hashes, of.sizes, np.log((pieces + SMOOTH) / total), float(np.log((n_bytes / 256 + SMOOTH) / total)), float(np.log((ends + SMOOTH) / total)))


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z to a-z; other characters stay."""
    return pc.ascii_lower(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trained = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for at, texts in slices(batch.column("_text")):
            offsets, flat = words(lower_ascii(texts))
            coded = flat.dictionary_encode()
            index, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            on = np.repeat(trained[at : at + len(texts)], np.diff(offsets))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(index[on], minlength=n)), pa.array(np.bincount(index, minlength=n))], ["word", "c", "seen"])


def score_documents(docs: DataFrame, train_on: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Learns from the rows where ``train_on`` holds; where it is null it does not. Tokens are the words in
    ASCII lower case and one end; null texts have the end alone. ``base_score`` is the add-one unigram
    word model's log10 probability, ``score`` the lattice model's. Every row is a text of its own, rows
    with equal or null ids too. With no training row all words are unknown. ``rounds`` of expectation
    follow the vocabulary's own scores; with none these are used as they are. An empty table has no rows.
    """
    with scratch() as keep:
        return keep(write_table(_scores(docs, train_on, model_path, id_col, text_col, head_words, rounds), "lm-scores"))


def _head(weighed: DataFrame, head_words: int) -> DataFrame:
    """The most frequent words, ``head_words`` at most: those of the highest classes of counts (eight to a doubling) that fit."""
    level = F.floor(8 * F.log2(F.greatest("seen", F.lit(1))))
    fits, total = None, 0
    for r in weighed.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 512 rows at most
        total += r["count"]
        if total > head_words:
            break
        fits = r.level
    return weighed.where(level >= fits) if fits is not None else weighed.limit(0)


def _scores(docs: DataFrame, train_on: Column, model_path: str, id_col: str, text_col: str, head_words: int, rounds: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    # rows are told apart by id and text; those that are equal in both have equal scores
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), F.coalesce(train_on, F.lit(False)).alias("train"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own"))
    counts = rows.select("_text", "train").mapInArrow(_count, "word string, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))
    vocabulary = write_table(counts, "lm-words")
    ends = rows.where("train").count()
    known = vocabulary.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = int(known.n or 0) + ends, int(known.v or 0) + (ends > 0)

    model = start(read_pieces(model_path))
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], of=shipped) -> Iterator[pa.RecordBatch]:
            pieces, n_bytes = np.zeros(len(of.value.hashes)), 0.0
            for batch in _gathered(batches):
                p, b = expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float), of.value)
                pieces += p
                n_bytes += b
            some = np.flatnonzero(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(pieces[some], n_bytes))], ["piece", "n"])

        got = vocabulary.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row per piece of the vocabulary at most
        pieces = np.zeros(len(model.hashes))
        for r in got:
            if r.piece >= 0:
                pieces[r.piece] = r.n
        model = reestimated(model, pieces, sum(r.n for r in got if r.piece < 0), ends)

    final = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words_ in _gathered(batches):
            log_p = word_log_p(words_.column("word").to_pylist(), final.value) / np.log(10)
            yield from words_.append_column("lp", pa.array(log_p)).to_batches()

    weighed = write_table(vocabulary.mapInArrow(weigh, "word string, c long, seen long, lp double"), "lm-weights")
    head = _head(weighed, head_words).select("word", "c", "lp").collect()  # head_words rows at most
    log_of = lambda c: float(np.log10((c + 1) / (n + v + 1)))
    table = spark.sparkContext.broadcast({r.word: (log_of(r.c), r.lp, int(r.c > 0)) for r in head})
    end = (log_of(ends), model.log_end / float(np.log(10)), int(ends > 0))
    columns = ["doc_id", "own", "word", "tf", "n_known", "base", "lp", "ends"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each document with what its end and frequent words add, keyed by no word; a row for each other word of it."""
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                ids, own_keys = (batch.column(c).slice(at, len(texts)) for c in ("doc_id", "own"))
                offsets, flat = words(lower_ascii(texts))
                coded = flat.dictionary_encode()
                found = [table.value.get(w) for w in coded.dictionary.to_pylist()]
                per = np.array([x or (0.0, 0.0, 0) for x in found]).reshape(-1, 3)
                index = coded.indices.to_numpy(zero_copy_only=False)
                sums = np.concatenate([np.zeros((1, 3)), np.cumsum(per[index], axis=0)]) if len(index) else np.zeros((1, 3))
                own = sums[offsets[1:]] - sums[offsets[:-1]]
                tail = np.array([x is None for x in found], bool)[index] if len(index) else np.zeros(0, bool)
                doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[tail]
                pair, tf = np.unique(doc * np.int64(max(1, len(found))) + index[tail], return_counts=True)
                in_head = np.diff(np.concatenate([[0], np.cumsum(~tail)])[offsets])
                keys = pa.array([f" {i}" for i in own_keys.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([ids, own_keys, keys, pa.array(in_head + 1), pa.array(np.rint(own[:, 2]).astype(np.int64) + end[2]), pa.array(own[:, 0] + end[0]), pa.array(own[:, 1] + end[1]), pa.array(np.ones(len(texts), np.int64))], columns)
                if len(pair):
                    d, w = np.divmod(pair, max(1, len(found)))
                    none = np.zeros(len(pair))
                    zero = pa.array(none.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), own_keys.take(pa.array(d)), coded.dictionary.take(pa.array(w)), pa.array(tf), zero, pa.array(none), pa.array(none), zero], columns)

    placed = rows.select("doc_id", "own", "_text").mapInArrow(place, "doc_id long, own long, word string, tf long, n_known long, base double, lp double, ends long")
    rare = weighed.select(F.col("word"), F.col("c").alias("_c"), F.col("lp").alias("_lp"))
    c = F.coalesce("_c", F.lit(0))
    is_word = ~F.col("word").startswith(" ")
    joined = placed.join(rare, "word", "left").select(
        "doc_id",
        "own",
        "ends",
        "tf",
        F.when(is_word, F.when(c > 0, F.col("tf")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(is_word, F.col("tf") * F.log10((c + 1) / F.lit(float(n + v + 1)))).otherwise(F.col("base")).alias("base"),
        F.when(is_word, F.col("tf") * F.col("_lp")).otherwise(F.col("lp")).alias("lp"),
    )
    summed = joined.groupBy("doc_id", "own").agg(*[F.sum(x).alias(x) for x in ("ends", "tf", "n_known", "base", "lp")])
    # as many rows as there were, in two steps so that no array is long
    each = summed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ends") - 1) / COPIES))))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("ends") - F.col("part") * COPIES))))
    whole = lambda x: F.floor(F.col(x) / F.col("ends")).cast("long")
    return each.select(
        "doc_id",
        whole("tf").alias("n_tokens"),
        whole("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"),
        (F.col("lp") / F.col("ends")).alias("score"),
    )
