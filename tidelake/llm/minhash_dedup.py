"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its five-word shingles weighted by how often they occur. Each shingle is a Poisson
process whose rate is its weight: its arrivals hit random registers, a register keeps the shingle of
its earliest arrival, and a shingle stops once its next arrival comes after the latest kept one. Equal
registers estimate the probability Jaccard similarity. Equal bands of registers make candidates; the
exact probability Jaccard of their whole texts decides.

Equal texts are one node. Both the estimates and the exact similarities make groups in two steps. All
nodes of a bucket are first held against its smallest one, which gathers a group of copies in linear
work; the nodes outside the bucket's largest group are then held against the whole bucket, in tiles of
bounded size. Only texts in a group by estimate are read again, each group's together: small groups in
one task, large ones in chunks, each with the same few pivots, and what these leave apart in tiles of
two chunks. Pairs within one component need no test, as they change no class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, gram_hashes, hash_words, mix64, scratch, slices, small_batches, words, write_table
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS = 24
ROWS = 6
REGISTERS = BANDS * ROWS
#: four standard deviations below the threshold; pairs estimated lower aren't verified
ESTIMATE = SIMILAR - 4 * math.sqrt(SIMILAR * (1 - SIMILAR) / REGISTERS)
TILE = 512
PIVOTS = 32
GROUP_ROWS = 20_000


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each row's distinct shingles; a row of fewer words is one shingle."""
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    grams = gram_hashes(hashes, size)
    row = row_of[: len(grams)]
    good = np.arange(len(grams)) + size <= offsets[1:][row]
    rows, found = [row[good]], [grams[good]]
    for k in range(1, size):
        short = np.flatnonzero(sizes == k)
        if len(short):
            rows.append(short)
            found.append(gram_hashes(hashes, k)[offsets[short]])
    row, gram = np.concatenate(rows), np.concatenate(found)
    _, first, count = np.unique(gram ^ mix64(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    order = np.argsort(row[first], kind="stable")
    return row[first][order], gram[first][order], count[order]


def signatures(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each row (n_rows x m); zero in rows without shingles."""
    at = np.full(n_rows * m, np.inf)
    held = np.zeros(n_rows * m, np.uint64)
    seed = mix64(gram)
    clock = np.zeros(len(gram))
    turn = np.uint64(0)
    golden = np.uint64(0x9E3779B97F4A7C15)
    weight = weight.astype(np.float64)
    with np.errstate(over="ignore"):
        while len(gram):
            turn += np.uint64(1)
            draw = mix64(seed + turn * golden)
            clock = clock - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / weight
            last = at.reshape(n_rows, m).max(axis=1) if n_rows else at
            alive = clock < last[row]
            row, gram, seed, clock, weight, draw = row[alive], gram[alive], seed[alive], clock[alive], weight[alive], draw[alive]
            cell = row * m + (mix64(draw ^ golden) % np.uint64(m)).astype(np.int64)
            np.minimum.at(at, cell, clock)
            won = at[cell] == clock
            held[cell[won]] = gram[won]
    return held.reshape(n_rows, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two (distinct hashes in order, counts): the sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    ratio = wb / wa
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # of the shared ones up to a ratio a's weight counts, of those above it b's
    up = np.searchsorted(ratio, ratio, side="right")
    below, above = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    return float((wa / (only_a + below[up] + (only_b + above[-1] - above[up]) / ratio)).sum())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column("_text")):
            offsets, flat = words(texts)
            row, gram, count = shingles(hash_words(flat), offsets)
            registers = signatures(row, gram, count, len(texts))
            full = np.zeros(len(texts), bool)
            full[row] = True
            with np.errstate(over="ignore"):
                bands = gram_hashes(mix64(registers).ravel(), ROWS)[:: ROWS].reshape(len(texts), BANDS) if len(texts) else np.empty((0, BANDS), np.uint64)
                bands = mix64(bands + np.arange(BANDS, dtype=np.uint64))
            offsets_b = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))])
            listed = pa.ListArray.from_arrays(pa.array(offsets_b, pa.int32()), pa.array(bands[full].ravel().view(np.int64)))
            short = (mix64(registers) >> np.uint64(56)).astype(np.uint8)
            bytes_ = pa.array([r.tobytes() for r in short], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(texts)), listed, bytes_], ["node", "bands", "sketch"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of one-byte registers, less chance agreement."""
    equal = (a == b).mean(axis=1)
    return (equal - 1 / 256) / (1 - 1 / 256)


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = _alike(_bytes(batch.column("sa")), _bytes(batch.column("sb"))) >= ESTIMATE if len(batch) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])


class _Forest:
    """Components of a task's nodes; ``join`` tells whether a link was new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _tiles(rows: pa.Table) -> pa.Table:
    """Pairs between the two sides of each tile that are alike by estimate, as few as join their components."""
    rows = rows.sort_by([("band", "ascending"), ("lc", "ascending"), ("rc", "ascending"), ("minor", "descending")])
    node, comp, minor, sketch = rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["minor"].to_numpy(), _bytes(rows["sketch"])
    key = np.stack([rows[c].to_numpy() for c in ("band", "lc", "rc")])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(node)]])
    forest = _Forest()
    out: list[tuple[int, int]] = []
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            for s in range(0, len(i), 100_000):
                x, y = i[s : s + 100_000], j[s : s + 100_000]
                keep = comp[x] != comp[y]
                x, y = x[keep], y[keep]
                good = _alike(sketch[x], sketch[y]) >= ESTIMATE
                for a, b in zip(x[good].tolist(), y[good].tolist()):
                    if forest.join(int(comp[a]), int(comp[b])):
                        out.append((int(node[a]), int(node[b])))
        left.clear()
        right.clear()

    for s, e in zip(starts.tolist(), ends.tolist()):
        k = s + int(minor[s:e].sum())
        if s < k < e:
            left.append(np.repeat(np.arange(s, k), e - k))
            right.append(np.tile(np.arange(k, e), k - s))
            size += (k - s) * (e - k)
            if size > 300_000:
                flush()
                size = 0
    flush()
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _verifier(similar: float):
    """Links between the similar texts of each cell of a group, as few as join them: all pairs of side 0, or sides 0 and 1 crosswise."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("cell", "ascending"), ("node", "ascending")])
        cell, node, comp, side, sketch = rows["cell"].to_numpy(), rows["node"].to_numpy(), rows["comp"].to_numpy(), rows["side"].to_numpy(), _bytes(rows["sketch"])
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        for part in rows["_text"].chunks:
            for _, some in slices(part):
                offsets, flat = words(some)
                row, gram, count = shingles(hash_words(flat), offsets)
                cut = np.searchsorted(row, np.arange(len(some) + 1))
                sets += [_ordered(gram[x:y], count[x:y]) for x, y in zip(cut[:-1], cut[1:])]
        out: list[tuple[int, int]] = []
        bounds = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            forest = _Forest()
            first, second = np.flatnonzero(side[s:e] == 0) + s, np.flatnonzero(side[s:e] == 1) + s
            for i in range(len(first)):
                a = first[i]
                others = second if len(second) else first[i + 1 :]
                if not len(others):
                    continue
                est = _alike(sketch[a][None, :], sketch[others])
                order = np.argsort(-est, kind="stable")
                for j in others[order[est[order] >= ESTIMATE]].tolist():
                    if node[a] != node[j] and forest.find(int(comp[a])) != forest.find(int(comp[j])) and similarity(sets[a], sets[j]) >= similar:
                        forest.join(int(comp[a]), int(comp[j]))
                        out.append((int(node[a]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _ordered(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(gram)
    return gram[order], count[order]


def _parts(n: Column) -> Column:
    return F.ceil(n / F.lit(TILE)).cast("int")


def _chunk(n: Column) -> Column:
    """The chunk of a node among n."""
    return F.pmod(F.xxhash64("node"), _parts(n)).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _or_self(nodes: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """Nodes with their component; a node without links is its own."""
    return nodes.join(comps.select("node", F.col("component").alias(name)), "node", "left").withColumn(name, F.coalesce(name, "node"))


def _groups_by_estimate(sketches: DataFrame) -> DataFrame:
    """``node, component`` under the links between nodes that share a bucket and are alike by estimate."""
    members = sketches.select("node", F.explode("bands").alias("band"))
    least = members.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    members = write_table(members.join(least, "band").select("band", "node", "a"), "near-buckets")
    short = sketches.select("node", "sketch")
    one, two = short.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), short.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    stars = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    likely = write_table(stars.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_likely, "a long, b long"), "near-stars")
    comps = components(likely)

    of = _or_self(members.select("band", "node"), comps, "comp")
    counted = of.groupBy("band", "comp").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("k")).where("k > 1").select("band", F.col("most.comp").alias("major"), (F.col("n") - F.col("most.n")).alias("n_minor"), "n")
    mixed = write_table(mixed, "near-mixed")
    cells = mixed.agg(F.sum(_parts(F.col("n_minor")) * F.col("n") + F.col("n_minor") * _parts(F.col("n")))).first()[0] or 0
    dealt = of.join(mixed, "band").join(short, "node").withColumn("minor", F.col("comp") != F.col("major"))
    columns = ["band", "node", "comp", "sketch", "minor", "lc", "rc"]
    n, m = F.col("n"), F.col("n_minor")
    lefts = dealt.where("minor").withColumn("lc", _chunk(m)).withColumn("rc", _each(_parts(n))).select(columns)
    rights = dealt.withColumn("minor", F.lit(False)).withColumn("rc", _chunk(n)).withColumn("lc", _each(_parts(m))).select(columns)
    tiled = lefts.unionByName(rights).withColumn("_g", F.pmod(F.xxhash64("band", "lc", "rc"), F.lit(max(1, math.ceil(int(cells) / GROUP_ROWS)))))
    across = tiled.groupBy("_g").applyInArrow(_tiles, "a long, b long")
    return components(likely.unionByName(across))


def _verify(rows: DataFrame, similar: float) -> DataFrame:
    """Links of the cells of rows (cell, node, comp, side, sketch, _text), dealt in groups of bounded size."""
    groups = max(1, math.ceil(rows.select("cell").count() / (4 * TILE)))
    return rows.withColumn("_g", F.pmod(F.xxhash64("cell"), F.lit(groups))).groupBy("_g").applyInArrow(_verifier(similar), "a long, b long")


def _verified_links(rows: DataFrame, first: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that give the components of exact similarity; rows: doc_id, node, _text."""
    found = _groups_by_estimate(sketches)
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    groups = write_table(found.join(sizes, "component").select("node", F.col("component").alias("grp"), "n"), "near-sized")
    wanted = write_table(groups.join(first, "node").select("node", "_first"), "near-wanted")
    # the texts in a group, from the first row of each; repeated identical rows are one
    texts = rows.join(checked_broadcast(wanted).withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_first"))).select("node", "_text")
    texts = write_table(texts.groupBy("node").agg(F.first("_text").alias("_text")).join(groups, "node").join(sketches.select("node", "sketch"), "node"), "near-texts")
    n = F.col("n")
    plain = texts.withColumn("comp", F.col("node")).withColumn("side", F.lit(0))
    columns = ["cell", "node", "comp", "side", "sketch", "_text"]
    chunked = plain.withColumn("cell", F.xxhash64("grp", _chunk(n))).select(columns)
    # the pivots of a large group are in each of its chunks
    order = F.row_number().over(Window.partitionBy("grp").orderBy("node"))
    pivots = groups.where(n > TILE).withColumn("_r", order).where(F.col("_r") <= PIVOTS).select("node")
    spread = plain.join(pivots, "node", "left_semi").withColumn("_c", _each(_parts(n))).where(F.col("_c") != _chunk(n)).withColumn("cell", F.xxhash64("grp", "_c")).select(columns)
    links = write_table(_verify(chunked.unionByName(spread), similar), "near-links")
    large = texts.where(n > TILE)
    if large.isEmpty():
        return links
    of = _or_self(groups.where(n > TILE), components(links), "comp")
    counted = of.groupBy("grp", "comp").agg(F.count("*").alias("k"))
    major = counted.groupBy("grp").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("all")).select("grp", F.col("most.comp").alias("major"), (F.col("all") - F.col("most.k")).alias("n_minor")).where("n_minor > 0")
    minor = write_table(of.join(major, "grp").select("node", "comp", "n_minor", (F.col("comp") != F.col("major")).alias("minor")), "near-minor")
    again = large.join(minor, "node")
    m = F.col("n_minor")
    cell = F.xxhash64("grp", "lc", "rc")
    lefts = again.where("minor").withColumn("side", F.lit(0)).withColumn("lc", _chunk(m)).withColumn("rc", _each(_parts(n))).withColumn("cell", cell).select(columns)
    rights = again.withColumn("side", F.lit(1)).withColumn("rc", _chunk(n)).withColumn("lc", _each(_parts(m))).withColumn("cell", cell).select(columns)
    return links.unionByName(_verify(lefts.unionByName(rights), similar))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``doc_id, text_hash, class_id, class_size, n_texts, kept`` of each row.

    A class is a connected component of texts of probability Jaccard ``similar`` or more, with all their
    copies; ``class_id`` is its smallest id, ``n_texts`` its number of different texts, and the row with
    that id is kept; of rows with one id the one whose ``text_hash`` is smallest. Texts of fewer than
    five words are one shingle; those without words only match identical ones; null counts as empty. Null ids are in no ``class_id``; a class of such alone has a
    null one. Rows that are alike in id and text are in no way told apart and all kept, or none.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("node"))
    ids = rows.select("doc_id", "node")
    first = ids.groupBy("node").agg(F.min("doc_id").alias("_first"))
    with scratch() as keep:
        sketches = write_table(rows.select("node", "_text").mapInArrow(_sketch, "node long, bands array<long>, sketch binary").groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sketches")
        classes = keep(components(_verified_links(rows, first, sketches, similar)))

    classed = ids.join(classes, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("_class"))
    per_text = classed.groupBy("_class", "node").agg(F.min("doc_id").alias("d"), F.count("*").alias("n"))
    # written, so that the join with the rows of a large class can be split
    least = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "node")).alias("least")
    sizes = per_text.groupBy("_class").agg(least, F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    sizes = write_table(sizes.select("_class", F.col("least.d").alias("class_id"), F.col("least.node").alias("_kept"), "class_size", "n_texts"), "near-classes")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("_kept"))
    return classed.join(sizes, "_class").select("doc_id", F.col("node").alias("text_hash"), "class_id", "class_size", "n_texts", kept.alias("kept"))
