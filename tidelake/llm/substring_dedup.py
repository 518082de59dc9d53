"""Substring deduplication by relative Lempel-Ziv parsing against reference blocks.

The windows of all documents are dealt to blocks by anchors: of the 28 eight-word grams in a window of 35
words, the one with the smallest hash (the leftmost of equals). Equal windows have equal anchors, so all
occurrences of a window meet in one block. A phrase is a run of windows with one anchor; it has 28
windows at most and no window twice. A block's reference is the different phrases of its anchor.

1. A phrase that occurs again as a whole is one factor, and a repeat at once. Counting them needs a few
   bytes for about 14 words.
2. Blocks with several phrases are indexed by a suffix array over their words, and each phrase is factored
   greedily: a factor is the longest match that its block has elsewhere. Windows within a factor of 35
   words or more repeat; windows that cross a factor's end are looked up in the same index.
3. Blocks of more than ``BLOCK_PHRASES`` phrases would be too much for one task. Their windows are counted
   one by one, by anchor and fingerprint, which is exact too and split like any count.
4. The repeats of a document are joined, and the words they cover become duplicate spans.

Keys are counted with map-side combining; the other joins are plain equi-joins that AQE splits where
a passage is common. Words are compared by 64-bit hashes, phrases and windows by 128 bits: their anchor
and their content.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, gram_hashes, hash_words, scratch, slices, small_batches, words, write_table

WINDOW = 35
GRAM = 8
BLOCK_PHRASES = 1024
GROUP_WORDS = 200_000
MADE = {"n_words": "long", "n_removed": "long", "spans": "array<struct<start: long, stop: long>>", "kept_text": "string"}


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of each ``span`` neighbours, the leftmost of equals."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    place, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        a, b = place[:-step], place[step:]
        place = np.where(grams[b] < grams[a], b, a)
        width += step
    return place[:n]


def phrases(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, row, first window and number of windows of each phrase of the rows."""
    prints, grams = gram_hashes(hashes, window), gram_hashes(hashes, gram)
    at = anchors(grams, window - gram + 1)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(prints)]
    place = np.arange(len(prints))
    good = place + window <= offsets[1:][row]
    starts = np.ones(len(prints), bool)
    starts[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(starts & good)
    # a phrase ends before the next start or where its row has no more windows
    ends = np.flatnonzero(good & np.concatenate([starts[1:] | ~good[1:], [True]]))[: len(first)] if len(first) else first
    n = ends - first + 1
    with np.errstate(over="ignore"):  # first and last window together cover every word of the phrase
        content = gram_hashes(np.stack([prints[first], prints[ends]], 1).ravel(), 2)[::2] if len(first) else np.empty(0, np.uint64)
        content = content + n.astype(np.uint64)
    return grams[at[first]], content, row[first], first - offsets[row[first]], n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _spans(batch_spans: pa.Array, at: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the spans of some rows."""
    some = batch_spans.slice(at, count)
    offsets = some.offsets.to_numpy().astype(np.int64)
    flat = some.flatten()
    row = np.repeat(np.arange(count), np.diff(offsets))
    return row, flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def longest_matches(codes: np.ndarray, ends: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in some phrases the length of its longest match elsewhere in its block, and where that is (-1: nowhere).

    ``codes`` are the words' hashes, phrase after phrase, ``ends`` and ``block`` the end of each place's
    phrase and its block's number. A suffix array by prefix doubling; neighbours in it match longest, and
    the classes of each doubling give their common length.
    """
    n = len(codes)
    place = np.arange(n)
    _, word = np.unique(codes, return_inverse=True)
    _, rank = np.unique((block.astype(np.int64) << 32) | word, return_inverse=True)
    classes, width = [rank], 1
    longest = int((ends - place).max(initial=1))
    while width < longest:
        after = np.where(place + width < ends, rank[np.minimum(place + width, n - 1)] + 1, 0)
        _, rank = np.unique((rank.astype(np.int64) << 32) | after, return_inverse=True)
        classes.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(classes) - 1, -1, -1):
        step, own = 1 << k, classes[k]
        x, y = a + common, b + common
        inside = (x + step <= ends[a]) & (y + step <= ends[b])
        same = np.zeros(len(a), bool)
        same[inside] = own[x[inside]] == own[y[inside]]
        common += same * step
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    length[b], source[b] = common, np.where(common > 0, a, -1)
    better = common > length[a]
    length[a[better]], source[a[better]] = common[better], b[better]
    return length, source


def factors(length: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of the greedy factors of all phrases, in order; a word without a match is a factor of its own."""
    at, to = starts.copy(), ends
    places, sizes = [], []
    while len(at):
        size = np.maximum(1, length[at])
        places.append(at)
        sizes.append(size)
        on = at + size < to
        at, to = (at + size)[on], to[on]
    place, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, sizes))
    order = np.argsort(place)
    return place[order], size[order]


def repeated_windows(length: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each place occurs again: within a long factor at once, across a factor's end by its own longest match."""
    place, size = factors(length, starts, ends)
    stop = np.repeat(place + size, size)  # where the factor of each place ends
    at = np.arange(len(length))
    within = at + window <= stop
    return within | (~within & (length >= window))


def _parse(window: int):
    """Runs of repeated windows in the phrases of some blocks."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("anchor", "ascending"), ("_key", "ascending"), ("start", "ascending")])
        lists = rows["words"].combine_chunks()
        codes = lists.flatten().to_numpy().view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
        ends_of = np.cumsum(sizes)
        anchor = rows["anchor"].to_numpy()
        block_of = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        row = np.repeat(np.arange(len(sizes)), sizes)
        length, _ = longest_matches(codes, ends_of[row], block_of[row])
        again = repeated_windows(length, ends_of - sizes, ends_of, window)
        first = again & np.concatenate([[True], ~again[:-1] | (row[1:] != row[:-1])])
        last = again & np.concatenate([~again[1:] | (row[1:] != row[:-1]), [True]])
        x, y = np.flatnonzero(first), np.flatnonzero(last)
        own = row[x]
        start = rows["start"].to_numpy()[own] + x - (ends_of - sizes)[own]
        return pa.table({"_key": rows["_key"].take(pa.array(own)), "start": pa.array(start, pa.int32()), "n": pa.array(y - x + 1, pa.int32())})

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """``_key, spans`` of the rows (_key, _text) with windows that start anywhere else; a span is (first window, number of windows)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                offsets, flat = words(texts)
                a, c, row, start, n = phrases(hash_words(flat), offsets, window)
                keys = batch.column("_key").slice(at, len(texts)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(c), keys, pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["anchor", "content", "_key", "start", "n"])

    found = write_table(rows.mapInArrow(parse, "anchor long, content long, _key long, start int, n int"), "rlz-phrases")
    distinct = found.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("_key", "start", "n")).alias("at"))
    distinct = write_table(distinct, "rlz-distinct")
    whole = write_table(found.join(distinct.where("c > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("_key", "start", "n"), "rlz-whole")
    drop_table(found)

    blocks = distinct.groupBy("anchor").agg(F.count("*").alias("d"), F.sum(F.col("at.n") + F.lit(window - 1)).alias("size")).where("d > 1")
    blocks = write_table(blocks.select("anchor", (F.col("d") <= block_phrases).alias("indexed"), "size"), "rlz-blocks")
    open_ = distinct.join(blocks, "anchor").select("at._key", F.struct("at.start", "at.n", "anchor", "indexed").alias("span"))
    listed = open_.groupBy("_key").agg(F.collect_list("span").alias("spans"))
    groups = max(1, math.ceil((blocks.where("indexed").agg(F.sum("size")).first()[0] or 0) / GROUP_WORDS))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each phrase of the indexed blocks, and the fingerprints of each window of the others'."""
        for batch in batches:
            for at, texts in slices(batch.column("_text")):
                offsets, flat = words(texts)
                hashes = hash_words(flat)
                some = batch.column("spans").slice(at, len(texts))
                cut = some.offsets.to_numpy().astype(np.int64)
                spans = some.flatten()
                row = np.repeat(np.arange(len(texts)), np.diff(cut))
                start, n = (spans.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                indexed = spans.field("indexed").to_numpy(zero_copy_only=False)
                keys, anchors_ = batch.column("_key").slice(at, len(texts)).take(pa.array(row)), spans.field("anchor")
                begin = offsets[row] + start
                for which, size in ((indexed, n + window - 1), (~indexed, n)):
                    which = np.flatnonzero(which)
                    if not len(which):
                        continue
                    size = size[which]
                    edges = np.concatenate([[0], np.cumsum(size)])
                    place = np.repeat(begin[which] - edges[:-1], size) + np.arange(edges[-1])
                    chosen = pa.array(which)
                    if indexed[which[0]]:
                        out = [keys.take(chosen), pa.array(start[which], pa.int32()), anchors_.take(chosen), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), _signed(hashes[place])), pa.nulls(len(which), pa.int64())]
                    else:
                        each = np.repeat(which, size)
                        prints = gram_hashes(hashes, window)
                        out = [keys.take(pa.array(each)), pa.array(place - offsets[row[each]], pa.int32()), anchors_.take(pa.array(each)), pa.nulls(len(each), pa.list_(pa.int64())), _signed(prints[place])]
                    yield pa.RecordBatch.from_arrays(out, ["_key", "start", "anchor", "words", "print"])

    cut = rows.join(listed, "_key").select("_key", "_text", "spans").mapInArrow(look, "_key long, start int, anchor long, words array<long>, print long")
    cut = write_table(cut, "rlz-cut")
    dealt = cut.where("words is not null").select("_key", "start", "anchor", "words").withColumn("_g", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    parsed = write_table(dealt.groupBy("_g").applyInArrow(_parse(window), "_key long, start int, n int"), "rlz-parsed")
    windows = cut.where("print is not null").select("_key", "start", "anchor", "print")
    again = windows.groupBy("anchor", "print").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "print")
    single = write_table(windows.join(again, ["anchor", "print"], "left_semi").select("_key", "start", F.lit(1).alias("n")), "rlz-single")
    return whole.unionByName(parsed).unionByName(single).groupBy("_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's columns, and ``n_words, n_removed, spans, kept_text``.

    Words covered by a window of ``window`` words that also starts anywhere else, in the same document
    too, are removed, all occurrences alike; windows are judged on the input. ``spans`` are the removed
    runs (first word, end word), ``kept_text`` the other words joined by one space. Null texts have no
    words; texts shorter than a window lose none. Identical rows repeat each other. An empty table gives
    an empty result. Columns of the input with one of the new names are replaced; all others, whatever
    their names, are carried along.
    """
    small_batches(docs.sparkSession)
    key = F.xxhash64(id_col, text_col).alias("_key")
    rows = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    with scratch() as keep:
        spans = keep(write_table(repeated_spans(rows, window), "rlz-spans"))
    made = list(MADE)
    carried = [c for c in docs.columns if c not in made]
    joined = docs.select(F.struct(*carried).alias("_row"), key).join(spans, "_key", "left").select("_row", "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_row").field(text_col)):
                offsets, flat = words(texts)
                total, sizes = len(flat), np.diff(offsets)
                row, start, n = _spans(batch.column("spans"), at, len(texts))
                mark = np.zeros(total + 1, np.int64)
                np.add.at(mark, offsets[row] + start, 1)
                np.add.at(mark, offsets[row] + start + n + window - 1, -1)
                gone = np.cumsum(mark)[:total] > 0
                edge = np.diff(np.concatenate([[0], gone.view(np.int8)]))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                # runs, also cut between rows
                first = gone & ((edge == 1) | np.concatenate([[True], owner[1:] != owner[:-1]])[:total])
                last = gone & np.concatenate([~gone[1:] | (owner[1:] != owner[:-1]), [True]])[:total]
                a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
                own = owner[a]
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(sizes) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(a - offsets[own]), pa.array(b - offsets[own])], ["start", "stop"]))
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[offsets[1:]] - lost[offsets[:-1]]
                kept = flat.filter(pa.array(~gone))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - lost[offsets], pa.int32()), kept), " ")
                same = batch.column("_row").slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([same, pa.array(sizes), pa.array(removed), runs.cast(span), text], ["_row", *made])

    schema = T.StructType([*joined.drop("spans").schema, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in MADE.items()))])
    return joined.mapInArrow(cut, schema).select(*[F.col("_row")[c].alias(c) for c in carried], *made)
