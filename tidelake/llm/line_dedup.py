"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is its set of words. Words are ordered by rarity: by the class of a hashed count over all
lines (a table of a fixed size), then by hash, which is one total order for all lines. Two lines
of Jaccard 0.8 share a word among the first few of both, at places that leave room for the overlap,
and have similar sizes: the prefix, positional and length filters. What passes is verified on the
whole sets. A line is removed if an earlier one is that similar.

Equal sets are one set from the start, so a line that very many documents share is one row in the
joins; sets of fewer than four words match equal ones alone and don't enter them. Semi-joins of the
prefix table with itself keep the rows that any other set may match, and everything after them works on
these few. There the earliest set of each prefix word is tried first: that settles the later lines of
a group of copies in linear work. The sets that it leaves open are held against all earlier ones that
the filters let pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, scratch, write_table

COUNTERS = 1 << 16
#: sets of more words have a second half of parity bits
LONG_SET = 80
_HASH_BITS = 56


def spaced(text: Column) -> Column:
    """The text with spaces for its other white space but line ends; texts without any are left alone."""
    odd = ("\t", "\x0b", "\x0c", "\r")
    found = F.contains(text, F.lit(odd[0]))
    for c in odd[1:]:
        found |= F.contains(text, F.lit(c))
    return F.when(found, F.translate(text, "".join(odd), " " * len(odd))).otherwise(text)


def split_words(line: Column) -> Column:
    """The words of a line of a ``spaced`` text, in order; splitting at one character needs no regular expression."""
    return F.array_remove(F.split(line, " "), "")


def rarity_classes(hashed: DataFrame) -> str:
    """The class (two to a doubling) of each hashed counter as one number after another, comma-separated; COUNTERS of them, whatever the corpus. hashed: words."""
    n_block = 1 << 10
    counted = (
        hashed.select(F.explode("words").alias("h"))
        .groupBy(F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).alias("b"))
        .agg(F.count("*").alias("n"))
        .unionByName(hashed.sparkSession.range(COUNTERS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("n")))
        .groupBy("b")
        .agg(F.least(F.floor(2 * F.log2(F.sum("n") + 1)), F.lit(127)).cast("string").alias("c"))
    )
    blocks = counted.groupBy(F.floor(F.col("b") / n_block).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "c"))), lambda x: x["c"]), ",").alias("t"))
    return ",".join(r.t for r in blocks.orderBy("k").collect())


def word_hashes(line: Column) -> Column:
    """The hashes of the distinct words of a line of a ``spaced`` text, in their order."""
    return F.sort_array(F.array_except(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit("")))))


def word_keys(hashes: Column, classes: str) -> Column:
    """The words of these hashes as numbers in the order of rarity."""
    table = F.split(F.lit(classes), ",").cast("array<bigint>")
    rarity = lambda h: F.shiftleft(table[h.bitwiseAND(F.lit(COUNTERS - 1))], _HASH_BITS)
    # never null, which spares the sort its comparisons of objects
    return F.sort_array(F.transform(hashes, lambda h: F.coalesce(rarity(h).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS)), F.lit(0).cast("long"))))


def parities(keys: Column, n: Column) -> list[Column]:
    """Every key flips one of 64 bits of ``flips``; of long sets, half of the keys flip one of ``odd`` too."""
    place = lambda k: k.bitwiseAND(F.lit(63)).cast("int")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    flip = lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", one, place(k)))
    flips = F.aggregate(keys, zero, flip)
    odd = F.aggregate(keys, zero, lambda bits, k: F.when(k.bitwiseAND(F.lit(64).cast("long")) == 0, bits).otherwise(flip(bits, k)))
    return [flips.alias("flips"), F.when(n > LONG_SET, odd).otherwise(zero).alias("odd")]


def _ceil(num: Column, of: int) -> Column:
    return F.floor((num + F.lit(of - 1)) / F.lit(of)).cast("int")


def n_probe(n: Column) -> Column:
    """How many of its rarest words can be the first one that a set shares with another."""
    return n - _ceil(4 * n, 5) + 1


def reach(n: Column, p: Column) -> Column:
    """The size of the largest set that one of n words may match by its word at place p, as the first that both have.

    They share n - p words at most, and 9 (n - p) >= 4 (n + m) has to hold for the other's size m.
    """
    return F.shiftright(5 * n - 9 * p, 2)


def _may_match(x: str, y: str) -> Column:
    """The filters, for two rows of the prefix table with one word: each within the other's reach, and parities.

    The reach is the length, prefix and positional filter in one. At a Jaccard of 0.8, a ninth of both
    sizes bounds the words that only one set has, and so the bits in which the parities of their words
    differ. Most chance pairs end there, unread.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    a = F.col(f"{x}.flips").bitwiseXOR(F.col(f"{y}.flips"))
    b = F.col(f"{x}.odd").bitwiseXOR(F.col(f"{y}.odd"))
    few = (9 * F.bit_count(a) <= n + m) & ((F.least(n, m) <= LONG_SET) | (9 * (F.bit_count(a.bitwiseXOR(b)) + F.bit_count(b)) <= n + m))
    return (m <= F.col(f"{x}.r")) & (n <= F.col(f"{y}.r")) & few


def lines_of(rows: DataFrame) -> DataFrame:
    """The lines that hold words: ``_key, _id, line_no, set, n, flips, odd, prefix``. ``set`` is the hash of their words. rows: _key, _id, _text.

    Words are cut out and hashed once; their hashes are kept until they are counted and the rarest of each line are known.
    """
    # hashes hardly recur, so a dictionary of them is work for nothing, as is much effort to compress those that soon go
    plain = {"parquet.enable.dictionary": "false"}
    lines = rows.select("_key", "_id", F.posexplode(F.split(spaced(F.col("_text")), "\n")).alias("line_no", "_line"))
    # generated, so that the words are cut out once and not in each place that names them
    found = lines.select("_key", "_id", "line_no", F.explode(F.array(word_hashes(F.col("_line")))).alias("words")).where("size(words) > 0")
    n, own = F.size("words"), ("_key", "_id", "line_no")
    with scratch() as keep:
        hashed = write_table(found.select(*own, F.xxhash64("words").alias("set"), n.alias("n"), *parities(F.col("words"), n), "words"), "line-words", compression="snappy", **plain)
        prefix = F.when(F.col("n") >= 4, F.slice(word_keys(F.col("words"), rarity_classes(hashed)), F.lit(1), n_probe(F.col("n"))))
        return keep(write_table(hashed.select(*own, "set", "n", "flips", "odd", prefix.alias("prefix")), "lines", **plain))


def prefix_rows(sets: DataFrame) -> DataFrame:
    """Rows (w, set, n, r, flips, odd) of the sets' rarest words; r is the row's reach. No column can be null, which spares the pairs a test for each."""
    rows = sets.select("set", "n", "flips", "odd", F.posexplode("prefix").alias("p", "w"))
    rows = rows.select("w", "set", "n", reach(F.col("n"), F.col("p")).alias("r"), "flips", "odd")
    return rows.select(*[F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns])


def _only(rows: DataFrame, condition: Column) -> DataFrame:
    """A filter that no exchange or join can change places with, as it makes ``n``: so two sides of a join share the exchange below."""
    return rows.select("w", "set", F.explode(F.when(condition, F.array("n"))).alias("n"), "r", "flips", "odd")


def candidate_rows(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of the prefix table that a row of another set may match.

    A row that reaches its own size is a head, any other one a tail, which reaches smaller sets alone: of
    two rows that match, one is a head. So all rows are held against the heads, which finds but the heads
    that only tails match; these few tails and the heads with their words are then held against each other.
    """
    prefixes = lines.where("prefix is not null").select("set", "n", "flips", "odd", "prefix")
    again = checked_broadcast(shared)
    sets = prefixes.join(again, "set", "left_anti").unionByName(prefixes.join(again, "set", "left_semi").distinct())
    dealt = prefix_rows(sets).repartition("w")
    head = F.col("r") >= F.col("n")
    found = write_table(_matching(_only(dealt, F.col("n") > 0), _only(dealt, head)), "line-found")
    tails = found.where(~head)
    words = checked_broadcast(write_table(tails.select("w").distinct(), "line-tail-words"))
    heads = prefix_rows(prefixes).where(head).join(words, "w", "left_semi").distinct()
    heads = heads.join(found.join(words, "w", "left_semi").select("w", "set"), ["w", "set"], "left_anti")
    return found.unionByName(write_table(_matching(heads, tails), "line-heads"))


def _matching(x: DataFrame, y: DataFrame) -> DataFrame:
    """The rows of x that a row of y with the same word and another set may match."""
    x, y = x.alias("x"), y.alias("y")
    return x.join(y, (F.col("x.w") == F.col("y.w")) & _may_match("x", "y") & (F.col("x.set") != F.col("y.set")), "left_semi")


def set_places(named: DataFrame, opened: DataFrame) -> DataFrame:
    """``set, at, k, open``: the first line and the number of lines of the sets of ``named`` lines; ``opened`` has those of candidates."""
    found = named.groupBy("set").agg(F.min(F.struct("_id", "_key", "line_no")).alias("at"), F.count("*").alias("k"))
    return found.join(checked_broadcast(opened).withColumn("o", F.lit(True)), "set", "left").select("set", "at", "k", F.coalesce("o", F.lit(False)).alias("open"))


def _texts_of(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``set, line`` of the sets (set, at); a text is cut into its lines once, whatever the number of lines wanted."""
    wanted = write_table(places.groupBy(F.col("at._key").alias("_key")).agg(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "set")).alias("some")), "line-wanted")
    cut = rows.select("_key", "_text").join(checked_broadcast(wanted), "_key").select("some", F.explode(F.array(F.split(spaced(F.col("_text")), "\n"))).alias("parts"))
    lines = F.transform("some", lambda s: F.struct(s["set"].alias("set"), F.col("parts")[s["line_no"]].alias("line")))
    return write_table(cut.select(F.inline(lines)).groupBy("set").agg(F.min("line").alias("line")), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``b`` of the pairs (a, b) of sets whose Jaccard is 0.8 or more."""
    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("set").alias("b"), F.col("line").alias("lb")), "b")
    wa, wb = (F.array_distinct(split_words(F.col(c))) for c in ("la", "lb"))
    both = both.select("b", F.explode(F.array(F.struct(wa.alias("a"), wb.alias("b")))).alias("w"))
    return both.where(9 * F.size(F.array_intersect("w.a", "w.b")) >= 4 * (F.size("w.a") + F.size("w.b"))).select(F.col("b").alias("set")).distinct()


def matched_sets(rows: DataFrame, candidates: DataFrame, places: DataFrame) -> DataFrame:
    """``set`` of the sets (set, at, open) whose first line has an earlier line of another set with a Jaccard of 0.8 or more."""
    own = write_table(places.where("open").select("set", "at"), "line-own")
    texts = _texts_of(rows, own)
    placed = write_table(candidates.join(checked_broadcast(own), "set").select("w", "at", "set", "n", "r", "flips", "odd"), "line-placed")
    row = F.struct(*[c for c in placed.columns if c != "w"])
    leaders = placed.groupBy("w").agg(F.min(row).alias("x"))
    near = placed.select("w", row.alias("y")).join(leaders, "w").where((F.col("x.at") < F.col("y.at")) & _may_match("x", "y"))
    settled = write_table(_verified(near.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct(), texts), "line-settled")

    x, y = placed.alias("x"), placed.join(checked_broadcast(settled), "set", "left_anti").alias("y")
    rest = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.at") < F.col("y.at")) & _may_match("x", "y"))
    found = _verified(rest.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct(), texts)
    return write_table(settled.unionByName(found), "line-matched")


def _gone_lines(rows: DataFrame) -> DataFrame:
    """``_key, _gone``: the numbers, rising, of the lines that go, of the texts that lose some.

    Only sets of several lines and those that may match another can lose a line; the other ones, most of all, are left behind.
    """
    lines = lines_of(rows)
    shared = write_table(lines.groupBy("set").agg(F.count("*").alias("k")).where("k > 1").select("set"), "line-shared")
    candidates = candidate_rows(lines, shared)
    opened = write_table(candidates.select("set").distinct(), "line-opened")
    wanted = write_table(shared.unionByName(opened).distinct(), "line-wanted-sets")
    named = write_table(lines.select("_key", "_id", "line_no", "set").join(checked_broadcast(wanted), "set", "left_semi"), "line-named")
    places = write_table(set_places(named, opened), "line-sets")
    matched = matched_sets(rows, candidates, places).withColumn("all", F.lit(True))
    limits = places.join(matched, "set", "left").where("k > 1 or all").select("set", "at", F.coalesce("all", F.lit(False)).alias("all"))
    gone = named.join(limits, "set").where(F.col("all") | (F.struct("_id", "_key", "line_no") > F.col("at")))
    return gone.groupBy("_key").agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))


def _without(parts: Column, gone: Column) -> Column:
    """The elements but for those at the rising places ``gone``: the stretches between these, one after another."""
    last = F.size(gone)
    begin = lambda i: F.when(i == 0, 0).otherwise(gone[F.greatest(i - 1, F.lit(0))] + 1)
    end = lambda i: F.when(i == last, F.size(parts)).otherwise(gone[F.least(i, last - 1)])
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(parts, begin(i) + 1, end(i) - begin(i))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with the text less its later lines, and ``n_lines, n_removed``.

    Lines end at a newline; a line's words are runs of other than white space. Lines are ordered by id,
    text hash and number; nulls come first. A line is removed if an earlier one, of any document, kept
    or not, has a Jaccard of 0.8 or more with it. Lines without words stay. A null text has no lines
    and stays null, an empty one has one; a document that loses all lines keeps an empty text.
    Identical rows lose the same lines, of which the first of them counts as earlier only within
    itself. Columns of the input named ``n_lines`` or ``n_removed`` are replaced; all others, whatever
    their names, are carried along.
    """
    key = F.xxhash64(id_col, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(key.alias("_key"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    with scratch() as keep:
        gone = keep(write_table(_gone_lines(rows), "line-gone"))
    carried = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*carried).alias("_row"), key.alias("_key")).join(checked_broadcast(gone), "_key", "left")
    cut = whole.select("_row", "_gone", F.explode(F.array(F.split(F.col("_row")[text_col], "\n"))).alias("_parts"))
    kept = F.array_join(_without(F.col("_parts"), F.col("_gone")), "\n")
    return cut.select(
        *[F.when(F.col("_gone").isNull(), F.col("_row")[c]).otherwise(kept).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in carried],
        F.coalesce(F.when(F.col("_parts").isNotNull(), F.size("_parts")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("n_removed"),
    )
