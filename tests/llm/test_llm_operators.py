"""The corpus operators against brute force on small tables, and their defined edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup, lattice_lm, line_dedup, minhash_dedup, packing, piece_bpe, substring_dedup, token_cache, topk_search, toxicity
from tidelake.llm.common import gram_hashes, hash_words, words, write_table
from tidelake.llm.components import components
from tidelake.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = tokenizer_path()
SCHEMA = "doc_id long, text string, lang string, _key string, n_words int, spans string, _gone int"


def frame(spark, texts, first=0):
    """A documents table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, None, "x", None, "s", 1) for i, t in enumerate(texts)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(60)
    out = [None, "", " \t\n", "one", "a b c d", "a b c d", "x " * 80, "\n\n", "é" * 3000]
    for _ in range(40):
        out.append("\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))))
    out += [out[10], out[11] + " tail", passage, f"{line(20)} {passage} {line(10)}", f"{passage}\n{line(40)}"]
    for base in out[12:16]:
        w = base.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out.append(" ".join(vocabulary * 5))
    return out


# op1


def brute_repeats(texts, size=35):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[tuple(d[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(d), sum(gone), " ".join(w for w, g in zip(d, gone) if not g)))
    return out


def test_substrings(spark, texts):
    found = substring_dedup.substring_dedup(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in found] == brute_repeats(texts)
    for r in found:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_substrings_edges(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    same = frame(spark, ["q " * 40]).unionByName(frame(spark, ["q " * 40]))
    assert [r.n_removed for r in substring_dedup.substring_dedup(same).collect()] == [40, 40]
    null = frame(spark, ["v%d " % i for i in range(3)]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_removed for r in substring_dedup.substring_dedup(null).collect()] == [0, 0, 0]


def test_phrases_cover_every_window_once():
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(n)] for n in (0, 10, 35, 36, 200, 34)]
    offsets = np.cumsum([0, *map(len, lists)])
    flat = hash_words(pa.array([w for x in lists for w in x], pa.string()))
    _, _, row, start, n = substring_dedup.phrases(flat, offsets)
    got = sorted((r, s + i) for r, s, k in zip(row, start, n) for i in range(k))
    assert got == [(r, i) for r, x in enumerate(lists) for i in range(len(x) - 34)] and n.max() <= 28


def brute_longest(phrases, blocks):
    """The longest match of each place elsewhere in its block."""
    places = [(k, i) for k, p in enumerate(phrases) for i in range(len(p))]

    def common(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    return [max((common(phrases[k][i:], phrases[m][j:]) for m, j in places if (m, j) != (k, i) and blocks[m] == blocks[k]), default=0) for k, i in places]


def test_factors_are_the_longest_matches():
    rng = random.Random(31)
    for turn in range(60):
        blocks = sorted(rng.randint(0, 2) for _ in range(rng.randint(1, 7)))
        phrases = [[rng.choice("abc") for _ in range(rng.randint(1, 20))] for _ in blocks]
        sizes = np.array([len(p) for p in phrases])
        ends_of = np.cumsum(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        codes = hash_words(pa.array([w for p in phrases for w in p], pa.string()))
        length, source = substring_dedup.longest_matches(codes, ends_of[row], np.array(blocks)[row])
        assert length.tolist() == brute_longest(phrases, blocks)
        flat = [w for p in phrases for w in p]
        for i, (n, j) in enumerate(zip(length.tolist(), source.tolist())):
            assert (j < 0) == (n == 0) and (n == 0 or (j != i and flat[i : i + n] == flat[j : j + n]))
        place, size = substring_dedup.factors(length, ends_of - sizes, ends_of)
        at = 0
        for x, n in zip(place.tolist(), size.tolist()):  # greedy, one after another, without a gap
            assert x == at and n == max(1, int(length[x]))
            at += n
        assert at == len(flat)
        again = substring_dedup.repeated_windows(length, ends_of - sizes, ends_of, 4)
        assert again.tolist() == [n >= 4 for n in length.tolist()]


def test_large_blocks_give_the_same_windows(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "_key long, _text string").where("_text is not null")

    def covered(limit):
        found = substring_dedup.repeated_spans(rows, 35, limit).collect()
        return {(r["_key"], s.start + i) for r in found for s in r.spans for i in range(s.n)}

    # all blocks indexed, all counted, and some of both
    assert covered(1024) == covered(1) == covered(2) != set()


# op2


def test_exact(spark, texts):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for own in groups.values():
        for i in own:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    long_ = "p" * 300  # equal lengths and prefixes, other ends
    got = exact_dedup.exact_dedup(frame(spark, [long_ + "a", long_ + "b", long_ + "a"])).orderBy("doc_id").collect()
    assert [r.keep_id for r in got] == [2, 1, 2]
    null = frame(spark, ["a", "a"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {(r.doc_id, r.kept) for r in exact_dedup.exact_dedup(null).collect()} == {(None, True), (1, True)}


# op3


def brute_similarity(a, b):
    union = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in union) for i in set(a) & set(b))


def counts(text, size=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def brute_classes(texts, similar=0.8):
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    bags = [counts(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or (bags[i] and bags[j] and brute_similarity(bags[i], bags[j]) >= similar):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(5)
    out = []
    for _ in range(4):  # groups of copies of a base, most alike through it alone
        base = [f"v{rng.randint(0, 3000)}" for _ in range(120)]
        for k in range(14):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
            out.append(" ".join(w))
    return out + [None, "", "  ", "a b", "a b", "a  b"] + [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(10)]


def test_near(spark, monkeypatch):
    texts = near_texts()
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[i].class_size == sizes[want[i]] and got[i].kept == (want[i] == i) for i in got)
    # the same with tiles so small that groups are cut
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    monkeypatch.setattr(minhash_dedup, "PIVOTS", 1)
    small = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert [small[i] for i in range(len(texts))] == want


def test_near_edges(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    null = frame(spark, ["a b c d e f"] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.class_id, r.kept) for r in minhash_dedup.near_duplicates(null).collect()] == [(None, True)] * 2
    repeated = frame(spark, ["a b c d e f"]).unionByName(frame(spark, ["a b c d e f"]))
    assert [r.class_size for r in minhash_dedup.near_duplicates(repeated).collect()] == [2, 2]


def test_similarity_of_weighted_shingles():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in range(2))
        as_sets = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert minhash_dedup.similarity(*as_sets) == pytest.approx(brute_similarity(a, b))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for keep in (400, 380, 300):
        other = np.concatenate([base[:keep], rng.integers(0, 2**63, 400 - keep).astype(np.uint64)])
        row = np.repeat([0, 1], 400)
        sig = minhash_dedup.signatures(row, np.concatenate([base, other]), np.ones(800, int), 2, 1024)
        assert abs((sig[0] == sig[1]).mean() - keep / (800 - keep)) < 0.06


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (5, 5)] + [(200, x) for x in range(201, 240)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 240)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op4


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(i, [int(x) for x in rng.integers(-3, 4, 8)]) for i in range(300)]
    data[17] = (17, data[16][1])
    extra = [(1000, None), (1001, [1, None, 1, 1, 1, 1, 1, 1]), (None, [1] * 8)]
    df = spark.createDataFrame(data + extra, "vec_id long, vector array<long>").withColumn("shard", F.lit(1))
    monkeypatch.setattr(topk_search, "SHARD", 16)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    monkeypatch.setattr(topk_search, "FAN_IN", 3)
    got = topk_search.exact_top_k(df.where("vec_id % 20 = 0"), df, 7).collect()
    want = topk_search.brute_top_k(pd.DataFrame(data, columns=["vec_id", "vector"]), set(range(0, 300, 20)), 7)
    assert sorted(map(tuple, got)) == sorted(want)
    few = topk_search.exact_top_k(df.where("vec_id = 0"), df.where("vec_id < 3"), 7)
    assert few.count() == 2
    assert topk_search.exact_top_k(df.where("vec_id < 0"), df, 7).count() == 0
    big = spark.createDataFrame([(0, [1 << 40, 1]), (1, [1 << 20, 3])], "vec_id long, vector array<long>")
    assert topk_search.exact_top_k(big.where("vec_id = 0"), big, 1).first().score == (1 << 60) + 3


# op5


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec(spark, texts, library):
    rng = random.Random(11)
    alphabet = "ab e▁ thn\n\t\rxé日🙂 the ingtion"
    many = texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [" ", "  ", " a", "a ", "a  b"]
    got = {r.doc_id: r for r in piece_bpe.encode_decode(frame(spark, many), MODEL).collect()}
    for i, t in enumerate(many):
        ids = library.encode(t or "")
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (",".join(map(str, ids)), len(ids), library.decode(ids))


def test_decode_of_any_ids(library):
    of = piece_bpe.codec(open(MODEL, "rb").read())
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randint(0, 9))]
        assert of.decode(ids) == library.decode(ids)
    with pytest.raises(IndexError):
        of.decode([32000])


# op6


def brute_lines(texts):
    lines = [(i, j, frozenset(WORD.findall(x))) for i, t in enumerate(texts) if t is not None for j, x in enumerate(t.split("\n"))]
    gone = set()
    for k, (i, j, s) in enumerate(lines):
        if s and any(r and 5 * len(s & r) >= 4 * len(s | r) for _, _, r in lines[:k]):
            gone.add((i, j))
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in enumerate(texts)]


def test_lines(spark, texts):
    rng = random.Random(4)
    near = []
    for n in (3, 4, 5, 9, 20, 60):
        base = [f"z{n}_{i}" for i in range(n)]
        for k in range(4):
            near.append(" ".join(rng.sample(base + [f"y{n}_{i}" for i in range(k)], n + k)))
    many = texts + near + ["\n".join(near), "a b c d\r\na b  c d"]
    got = line_dedup.line_dedup(frame(spark, many)).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute_lines(many)
    assert [r.n_lines for r in got] == [0 if t is None else t.count("\n") + 1 for t in many]


def test_lines_edges(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    out = line_dedup.line_dedup(frame(spark, [None, ""])).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines) for r in out] == [(None, 0), ("", 1)]
    assert line_dedup.line_dedup(frame(spark, ["a b"])).columns == SCHEMA.replace(",", "").split()[::2] + ["n_lines", "n_removed"]


def test_lines_place_open_sets_alone(spark, monkeypatch):
    """The table of first lines has the sets of several lines and those that may match another, not all sets."""
    rows = {}

    def counted(df, name, **options):
        out = write_table(df, name, **options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "write_table", counted)
    alone = [" ".join(f"a{i}_{k}" for k in range(9)) for i in range(50)]
    near = " ".join(f"n{k}" for k in range(19))
    got = line_dedup.line_dedup(frame(spark, [*alone, "x y", "y x", near, f"{near} more"])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0] * 50 + [0, 1, 0, 1]
    assert rows["lines"] == 54 and rows["line-sets"] == 3


def test_reach_is_the_length_prefix_and_position_filters(spark):
    sizes = [(n, i) for n in range(4, 41) for i in range(n - math.ceil(0.8 * n) + 1)]
    got = {(r.n, r.p): r.r for r in spark.createDataFrame(sizes, "n int, p int").select("n", "p", line_dedup.reach(F.col("n"), F.col("p")).alias("r")).collect()}
    for (n, i), (m, j) in itertools.product(sizes, sizes):
        lengths = 4 * m <= 5 * n and 4 * n <= 5 * m
        prefixes = (n > m or 9 * i <= n) and (m > n or 9 * j <= m)
        assert (lengths and prefixes and 9 * min(n - i, m - j) >= 4 * (n + m)) == (m <= got[n, i] and n <= got[m, j])


def test_lines_candidates_are_those_of_all_pairs(spark, monkeypatch):
    """Words are cut once, and heads against all rows find each row once that another set may match."""
    tables = {}

    def kept(df, name, **options):
        tables[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write_table(df, name, **options)

    monkeypatch.setattr(line_dedup, "write_table", kept)
    rng, many = random.Random(8), []
    for k in range(60):
        base = [f"c{rng.randrange(900)}" for _ in range(rng.randint(4, 60))]
        many += [" ".join(rng.sample(base, len(base) - rng.randrange(len(base) // 5 + 1)) + [f"d{k}_{j}" for j in range(rng.randrange(3))]) for _ in range(rng.randint(1, 5))]
    many += many[::4]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(many)], "_key long, _id long, _text string")
    lines = line_dedup.lines_of(rows)
    shared = kept(lines.groupBy("set").count().where("count > 1").select("set"), "shared")
    got = [(r.w, r.set) for r in line_dedup.candidate_rows(lines, shared).collect()]
    assert sum("split(_line" in plan for plan in tables.values()) == 1

    sets = {r.set: r for r in lines.where("prefix is not null").collect()}
    prefix = [(w, s.set, s.n, (5 * s.n - 9 * p) // 4, s.flips, s.odd) for s in sets.values() for p, w in enumerate(s.prefix)]
    want, tail_alone = set(), 0
    for w, a, n, r, f, o in prefix:
        found = [x for x in prefix if x[0] == w and x[1] != a and x[2] <= r and n <= x[3] and 9 * bin((f ^ x[4]) % 2**64).count("1") <= n + x[2]]
        assert max(s.n for s in sets.values()) <= line_dedup.LONG_SET
        if found:
            want.add((w, a))
            tail_alone += r >= n and all(x[3] < x[2] for x in found)
    assert sorted(got) == sorted(want) and tail_alone and len(want) < len(prefix)


def test_lines_run_no_python(spark, texts):
    plan = line_dedup.line_dedup(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# op7


def test_packing(spark):
    rng = random.Random(9)
    sizes = [0, None, 1, 8192, 8193, 30000, -4] + [rng.randint(1, 9000) for _ in range(300)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n int, bin_id string")
    got = packing.pack(df, "n", shard_pieces=100).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: max(0, n or 0) for i, n in enumerate(sizes)}
    real = got.dropna()
    for _, own in real.groupby("bin_id"):
        own = own.sort_values("bin_offset")
        assert list(own.bin_offset) == list(np.cumsum([0, *own.length[:-1]]))
        load, capacity = own.length.sum(), own.capacity.iloc[0]
        assert (own.bin_load == load).all() and capacity == min(c for c in packing.CAPACITIES if c >= load)
    assert real.drop_duplicates("bin_id").bin_load.sum() / real.drop_duplicates("bin_id").capacity.sum() > 0.95
    assert packing.pack(df.where("doc_id < 0"), "n").count() == 0


def plain_best_fit(sizes, capacity):
    """The loads when each size goes into the fullest bin of one capacity that has room."""
    loads = []
    for n in sizes:
        fits = [i for i, x in enumerate(loads) if x + n <= capacity]
        if fits:
            loads[max(fits, key=lambda i: loads[i])] += n
        else:
            loads.append(n)
    return loads


def least_cost(sizes, capacities, overhead):
    """Over all ways to part the sizes into bins."""
    if not sizes:
        return 0
    best = math.inf
    first, rest = sizes[0], sizes[1:]
    for k in range(1 << len(rest)):
        load = first + sum(n for i, n in enumerate(rest) if k >> i & 1)
        if load <= max(capacities):
            own = min(c for c in capacities if c >= load) + overhead
            best = min(best, own + least_cost([n for i, n in enumerate(rest) if not k >> i & 1], capacities, overhead))
    return best


def test_plans_against_plain_best_fit_and_the_optimum():
    rng = random.Random(17)
    capacities = [8, 16, 32]
    cost = lambda loads: sum(min(c for c in capacities if c >= x) + 2 for x in loads)
    worst = 1.0
    for _ in range(150):
        sizes = sorted([rng.choice([rng.randint(1, 32), 8, 16]) for _ in range(rng.randint(1, 7))], reverse=True)
        bins, loads = packing.best_plan(np.array(sizes), capacities, 2)
        assert [sum(n for n, b in zip(sizes, bins) if b == k) for k in range(len(loads))] == loads
        for c in capacities:
            if c >= sizes[0]:
                single = packing.plan(np.array(sizes), capacities, c, 2)[1]
                assert sorted(single) == sorted(plain_best_fit(sizes, c)) if c == capacities[-1] else True
                assert cost(loads) <= cost(plain_best_fit(sizes, c))
        worst = max(worst, cost(loads) / least_cost(sizes, capacities, 2))
    assert worst <= 1.25


def test_rows_with_null_and_equal_ids_are_packed_each(spark):
    df = spark.createDataFrame([(None, 400)] * 5 + [(7, 400)] * 5 + [(8, 400)], "doc_id long, n int")
    got = packing.pack(df, "n", shard_pieces=4).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("7", 400)] * 5 + [("8", 400)] + [("None", 400)] * 5
    assert all(r.bin_load <= r.capacity for r in got)


def test_best_fit_takes_the_fullest_bin():
    bins, loads = packing.plan(np.array([90, 70, 30, 10]), [100], None, 0)
    assert bins == [0, 1, 1, 0] and loads == [100, 100]
    assert packing.best_plan(np.array([300, 200]), [512, 1024], 0)[1] == [500]


# op8


def brute_marginal(word, pieces, byte):
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = pieces.get(word[i:j], byte ** len(word[i:j].encode()) if j - i == 1 else 0.0)
            total[j] += total[i] * p
    return math.log(total[-1])


def test_lattice_marginal_and_expectation():
    vocabulary = [("▁", -1.0), ("a", -2.0), ("b", -3.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -6.0)]
    of = lattice_lm.start(vocabulary)
    by_hash = {int(h): p for h, p in zip(of.hashes, np.exp(of.log_p))}
    pieces = {v: by_hash[int(gram_hashes(lattice_lm._char_hash(np.array([ord(c) for c in v])), len(v))[0])] for v, _ in vocabulary}
    some = ["ab", "aba", "b", "xé", "abababab", "日"]
    got = lattice_lm.word_log_p(some, of)
    assert got == pytest.approx([brute_marginal("▁" + w, pieces, math.exp(of.log_byte)) for w in some])
    # what is expected of the pieces spells all characters
    n, n_bytes = lattice_lm.expected(some, np.ones(len(some)), of)
    assert float((n * of.sizes).sum()) + 2 == pytest.approx(sum(len(w) + 1 for w in some) - 1) and n_bytes == pytest.approx(6)


def test_lm(spark, texts):
    train = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in lattice_lm.score_documents(frame(spark, texts), train, MODEL, head_words=50).collect()}
    assert len(got) == len(texts)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [WORD.findall((t or "").translate(lower)) + ["\n"] for t in texts]
    c = Counter(w for i, d in enumerate(docs) if i % 3 for w in d)
    n, v = sum(c.values()), len(c)
    for i, d in enumerate(docs):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(d), sum(c[w] > 0 for w in d), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d))
        assert math.isfinite(r.score) and r.score < 0
    # the head's size is a matter of transport alone
    other = {r.doc_id: r.score for r in lattice_lm.score_documents(frame(spark, texts), train, MODEL, head_words=5).collect()}
    assert all(other[i] == pytest.approx(got[i].score) for i in other)
    assert lattice_lm.score_documents(frame(spark, []), train, MODEL).count() == 0
    assert lattice_lm.score_documents(frame(spark, ["a"]), F.lit(False), MODEL).first().n_known == 0


def test_lm_scores_each_row_by_the_vocabulary_alone(spark):
    rows = [(1, "aa The"), (1, "aa The"), (1, "other"), (None, "x y"), (None, "Zé 日"), (None, None), (2, ""), (3, "q" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = lattice_lm.read_pieces(MODEL)
    ranked = sorted(range(len(pieces)), key=lambda i: -pieces[i][1])
    weight = {pieces[i][0]: 1 / (r + 10) for r, i in enumerate(ranked)}
    total = sum(weight.values())
    p = {w: x / total * 0.98 for w, x in weight.items()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def log10(text):
        return (sum(brute_marginal("▁" + w, p, 0.01 / 256) for w in WORD.findall((text or "").translate(lower))) + math.log(0.01)) / math.log(10)

    got = lattice_lm.score_documents(df, F.col("doc_id") == 1, MODEL, rounds=0).collect()
    key = lambda r: (str(r[0]), r[1])
    some = [(i, t) for i, t in rows if len(t or "") < 700]  # the product of many small numbers has no floating-point value
    want = sorted([(i, log10(t)) for i, t in some], key=key)
    have = sorted([(r.doc_id, r.score) for r in got if r.doc_id != 3], key=key)
    assert [i for i, _ in have] == [i for i, _ in want] and [x for _, x in have] == pytest.approx([x for _, x in want])
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 3, 3, 3, 3] and {r.train_tokens for r in got} == {8}


def test_long_words_go_through_the_same_recursion(monkeypatch):
    rng = random.Random(21)
    of = lattice_lm.start([("▁", -1.0), ("a", -2.0), ("b", -3.0), ("ab", -4.0), ("▁a", -5.0), ("bab", -6.0), ("aabb", -7.0)])
    some = ["".join(rng.choice("abé日") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 30, 200)]
    weights = np.arange(1, len(some) + 1).astype(float)
    want, (pieces, n_bytes) = lattice_lm.word_log_p(some, of), lattice_lm.expected(some, weights, of)
    for long_, block in ((0, 3), (0, 4096), (7, 8)):
        monkeypatch.setattr(lattice_lm, "LONG_WORD", long_)
        monkeypatch.setattr(lattice_lm, "BLOCK", block)
        assert lattice_lm.word_log_p(some, of) == pytest.approx(want)
        got, bytes_ = lattice_lm.expected(some, weights, of)
        assert got == pytest.approx(pieces) and bytes_ == pytest.approx(n_bytes)


# op9


def test_token_counts(spark, texts, tmp_path, library):
    cache = f"{tmp_path}/cache"
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_cache.token_counts(frame(spark, texts), MODEL, cache).collect()}
        assert got == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # hits add nothing
    more = frame(spark, ["fresh text"], first=900).unionByName(frame(spark, ["again", "again"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert token_cache.token_counts(more, MODEL, cache).count() == 3
    assert token_cache.token_counts(frame(spark, []), MODEL, cache).count() == 0


def test_token_counts_of_a_json_tokenizer(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    of = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_cache.token_counts(frame(spark, texts), path, f"{tmp_path}/c").collect()}
    assert got == {i: len(of.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# op10


def brute_passages(s):
    """Maximal segments by their definition: each best segment, then the same left and right of it."""
    s = list(s)
    best, at = 0.0, None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > best:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    shift = lambda k, found: [(x + k, y + k, z) for x, y, z in found]
    return brute_passages(s[:a]) + [(a, b, best)] + shift(b, brute_passages(s[b:]))


def test_passages():
    rng = random.Random(6)
    for _ in range(300):
        # weights without equal sums, so that the definition leaves no choice
        s = np.array([rng.choice([-1, -1, -1, 1, 2]) * (1 + rng.random()) for _ in range(rng.randint(0, 25))])
        got = toxicity.passages(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_passages(s)]
        assert [x for _, _, x in got] == pytest.approx([x for _, _, x in brute_passages(s)])


def test_toxicity_learns(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(800):
        w = [f"w{rng.randint(0, 80)}" for _ in range(rng.randint(0, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(6):
                w.insert(len(w) // 2, rng.choice(["Idiot!", "trash", "loser***"]))
        docs.append(" ".join(w))
        labels.append((i, int(toxic)))
    docs[1] = None
    df, lab = frame(spark, docs), spark.createDataFrame([*labels, (None, 1), (5, None), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab, F.col("doc_id") % 3 != 0)
    assert {"idiot", "trash", "loser"} <= {t for t, d in model.odds.items() if d > 0}
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(800) if i % 3 == 0]
    assert np.mean([(got[i].score >= 0.3) == bool(labels[i][1]) for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].passages and not got[1].passages
    kept = toxicity.reject(df, model, 0.3)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.3}


def test_toxicity_by_plain_python(spark, monkeypatch):
    """Counts, log-odds, lambda, chance level, weights and scores of a small corpus, each by its definition."""
    rng = random.Random(14)
    docs = []
    for i in range(90):
        w = [f"w{rng.randint(0, 25)}" for _ in range(rng.randint(1, 30))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = rng.choices(["Idiot!", "trash", "w3"], k=rng.randint(1, 6))
        docs.append(" ".join(w))
    monkeypatch.setattr(toxicity, "PRIOR", 50.0)
    monkeypatch.setattr(toxicity.log_odds, "__defaults__", (50.0, toxicity.Z_LEAST))
    df = frame(spark, docs)
    model = toxicity.train(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"), F.lit(True))
    words_ = [[w.lower().strip(toxicity.string.punctuation) for w in d.split()] for d in docs]
    order = [r.doc_id for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).orderBy("h", "doc_id").collect()]
    fold, seen = {}, [0, 0]
    for i in order:
        y = int(i % 3 == 0)
        fold[i] = seen[y] % toxicity.FOLDS
        seen[y] += 1

    def fitted(rows):
        c = [Counter(w for i in rows if (i % 3 == 0) == bool(y) for w in words_[i]) for y in (0, 1)]
        n0, n1 = (sum(x.values()) for x in c)
        odds = {}
        for t in {*c[0], *c[1]}:
            y0, y1 = c[0][t], c[1][t]
            a = 50.0 * (y1 + y0) / (n1 + n0)
            d = math.log((y1 + a) / (n1 + 50.0 - y1 - a)) - math.log((y0 + a) / (n0 + 50.0 - y0 - a))
            if abs(d) / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= toxicity.Z_LEAST:
                odds[t] = max(-3.0, min(6.0, d))
        return odds, c[0], n0

    odds, background, n0 = fitted(range(90))
    assert model.odds == pytest.approx(odds) and "idiot" in odds
    balance = lambda lam, odds, c, n: sum(k / n * math.exp(lam * (odds.get(t, 0.0) - model.shift)) for t, k in c.items())
    assert model.lam == pytest.approx(8.0) or balance(model.lam, odds, background, n0) == pytest.approx(1.0, abs=1e-6)
    nats = {}
    for f in range(toxicity.FOLDS):
        own, c, n = fitted([i for i in range(90) if fold[i] != f])
        low, high = 1e-6, 8.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if balance(mid, own, c, n) < 1 else (low, mid)
        for i in range(90):
            if fold[i] == f:
                nats[i] = [min(8.0, low) * x for _, _, x in brute_passages([own.get(w, 0.0) - model.shift for w in words_[i]])]
    level = [max(x) - math.log(len(words_[i])) for i, x in nats.items() if i % 3 and x]
    assert model.log_k == pytest.approx(sum(level) / len(level) - 0.5772, abs=1e-6)

    def described(found, n):
        above = [x - math.log(n) - model.log_k for x in found]
        return max(above, default=-math.log(n) - model.log_k), math.log1p(sum(x for x in above if x >= model.level))

    x = np.array([described(nats[i], len(words_[i])) for i in range(90)])
    y = np.array([i % 3 == 0 for i in range(90)], float)
    p = 1 / (1 + np.exp(-(model.weights[0] + x @ np.array(model.weights[1:]))))
    z = (x - x.mean(axis=0)) / x.std(axis=0)  # the penalised loss is flat at the weights
    slopes = np.array(model.weights[1:]) * x.std(axis=0)
    assert z.T @ (y - p) - slopes == pytest.approx(np.zeros(2), abs=1e-4)
    for r in toxicity.score(df, model).collect():
        a, b = described([model.lam * s for _, _, s in brute_passages([odds.get(w, 0.0) - model.shift for w in words_[r.doc_id]])], len(words_[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * a + model.weights[2] * b))), abs=1e-6)


def test_toxicity_without_labels(spark):
    df = frame(spark, ["a", None])
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert all(r.score < 0.3 for r in toxicity.score(df, model).collect())
    assert toxicity.score(frame(spark, []), model).count() == 0


# shared pieces


def test_words_are_those_of_the_pattern():
    rng = random.Random(12)
    some = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x85 é") for _ in range(rng.randint(0, 15))) for _ in range(500)]
    offsets, flat = words(pa.array(some))
    got = flat.to_pylist()
    assert [got[a:b] for a, b in zip(offsets[:-1], offsets[1:])] == [WORD.findall(t) for t in some]


def test_written_tables_keep_their_types(spark):
    df = spark.sql("SELECT 1 AS a, array(struct(2L AS b)) AS c")
    out = write_table(df, "t")
    assert out.dtypes == df.dtypes and out.collect() == df.collect()
