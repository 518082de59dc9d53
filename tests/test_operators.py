from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.functions import lattice
from tidelake.functions.time import register_time_bucket, time_bucket, timestamp_of_ns
from tidelake.operators.dedup import merge_columns, newest_by_seq
from tidelake.operators.intervals import covered_chunks, covers, islands, merge_intervals
from tidelake.operators.joins import asof_join
from tidelake.plans import sqlapi
from tidelake.plans.federation import empty, lattice_types, union_by_name
from tidelake.sources.manifest import prune, staging_key


def test_two_tiers(spark):
    hot = spark.createDataFrame([(1, 100, 50, 9.9)], "time int, tag_hash long, seq long, f_value double").withColumn("_rank", F.lit(3))
    cold = spark.createDataFrame([(1, 100, 10, 1.1), (2, 100, 20, 2.2)], "time int, tag_hash long, seq long, f_value double").withColumn("_rank", F.lit(0))
    assert sorted(map(tuple, newest_by_seq(hot.unionByName(cold)).select("time", "f_value").collect())) == [(1, 9.9), (2, 2.2)]


def test_tag_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS time", "id AS tag_hash", "id AS seq", "string(id) AS t_host").write.parquet(str(tmp_path / "t"))
    df = newest_by_seq(spark.read.parquet(str(tmp_path / "t"))).where("t_host = '3' AND time > 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t_host,3)" in plan and "WindowGroupLimit" in plan


def test_column_merge(spark):
    rows = [(1, 7, 1, 1.0, 5, ["a", "b"]), (1, 7, 2, None, None, ["a"]), (1, 7, 3, None, 6, ["b"]), (2, 7, 1, 4.0, None, ["a"])]
    df = spark.createDataFrame(rows, "time int, tag_hash long, seq long, a double, b int, _cols array<string>")
    assert sorted(map(tuple, merge_columns(df, ["a", "b"]).collect())) == [(1, 7, 3, None, 6), (2, 7, 1, 4.0, None)]


def test_intervals(spark):
    spans = [(20, 26), (3, 5), (9, 14), (5, 9), (12, 13), (22, 31), (40, 40)]
    found = islands(spans)
    assert found == ([3, 20, 40], [14, 31, 40])
    assert covers(found, 3, 14) and covers(found, 25, 31) and covers(found, 40, 40) and covers(found, 6, 6)
    assert not covers(found, 2, 4) and not covers(found, 13, 20) and not covers(found, 30, 40) and not covers(islands([]), 1, 1)
    df = spark.createDataFrame([("x", a, b) for a, b in spans] + [("y", 8, 11)], "m string, range_start int, range_end int")
    assert sorted(map(tuple, merge_intervals(df, ["m"]).collect())) == [("x", 3, 14, 4), ("x", 20, 31, 2), ("x", 40, 40, 1), ("y", 8, 11, 1)]
    chunks = spark.createDataFrame([("x", 4, 13), ("x", 14, 21), ("z", 8, 9)], "m string, chunk_start int, chunk_end int")
    assert {(r.m, r.chunk_start): r.covered for r in covered_chunks(chunks, df, ["m"]).collect()} == {("x", 4): True, ("x", 14): False, ("z", 8): False}


def test_islands_in_slices_of_time(spark):
    rng = random.Random(3)
    spans = [(rng.choice(["x", "y", None]), a, a + rng.choice([1, 2, 5, 300])) for a in rng.sample(range(3000), 120)]
    df = spark.createDataFrame(spans, "m string, range_start int, range_end int")
    got = sorted(map(str, merge_intervals(df, ["m"], rows_a_slice=9).collect()))
    assert got == sorted(map(str, merge_intervals(df, ["m"]).collect()))
    want = [(m, a, b) for m in ("x", "y", None) for a, b in zip(*islands((a, b) for own, a, b in spans if own == m))]
    assert sorted((r.m, r.range_start, r.range_end) for r in merge_intervals(df, ["m"], rows_a_slice=9).collect() if r.m) == sorted(x for x in want if x[0])


def test_pruning_counts_both_ends(spark):
    df = spark.createDataFrame([(i, datetime(2025, 3, a), datetime(2025, 3, b)) for i, (a, b) in enumerate([(2, 4), (4, 7), (11, 12)])], "i int, range_start timestamp, range_end timestamp")
    ids = lambda *w: sorted(r.i for r in prune(df, *w).collect())
    assert ids("2025-03-04", "2025-03-10") == [0, 1] and ids("2025-03-07", None) == [1, 2]
    assert ids(None, "2025-03-02") == [0] and ids("2025-03-08", "2025-03-10") == [] and ids(None, None) == [0, 1, 2]
    assert staging_key("disk", 37, 1204) == "disk/staging/00000000000000000037-00000000000000001204"


def test_lattice_union(spark):
    a = spark.sql("SELECT 1 AS id, true AS x, 1.5D AS y, false AS z")
    b = spark.sql("SELECT 2 AS id, 7L AS x, 'text' AS y, 2.5D AS z, 9L AS extra")
    rows = union_by_name([a, b], lattice_types([a, b])).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "1.5", 0.0, None), (2, 7, "text", 2.5, 9)]
    big = spark.sql("SELECT 1e20D AS v").select(lattice.widen(F.col("v"), "double", "string").alias("v"))
    assert big.first().v == "1e+20"
    assert empty(spark, {"a": "int"}).count() == 0
    with pytest.raises(ValueError):
        union_by_name([], {})
    with pytest.raises(ValueError):
        lattice.widen(F.lit("x"), "string", "bigint")


def test_time(spark):
    register_time_bucket(spark)
    t = F.to_timestamp(F.lit("2024-03-14 15:09:26"))
    got = spark.range(1).select(*[time_bucket(w, t).cast("string").alias(w) for w in ("1 minute", "7 days", "1 month", "1 year")]).first()
    assert list(got) == ["2024-03-14 15:09:00", "2024-03-11 00:00:00", "2024-03-01 00:00:00", "2024-01-01 00:00:00"]
    assert spark.sql("SELECT string(time_bucket('1 year', TIMESTAMP'1969-03-14 15:09:26')) AS x").first().x == "1969-01-01 00:00:00"
    ns = [1_700_000_000_123_456_789, -1_500, 0, 999, 1_609_459_199_999_999_500, -62_135_596_800_000_000_000 // 10]
    out = spark.createDataFrame([(n,) for n in ns], "ns long").select("ns", F.unix_micros(timestamp_of_ns(F.col("ns"))).alias("us")).collect()
    for r in out:
        want = datetime.fromtimestamp(r.ns / 1_000_000_000, UTC) - datetime(1970, 1, 1, tzinfo=UTC)
        assert timedelta(microseconds=r.us) == want


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, "l1"), ("a", 1, "l2"), ("b", 9, "l3")], "k string, t int, id string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60)], "k string, at int, v int")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {"l1": 50, "l2": None, "l3": None}


def test_asof_in_slices_of_time(spark):
    rng = random.Random(9)
    right = [(rng.choice("ab"), t, rng.randint(0, 99)) for t in rng.sample(range(0, 2000), 60)]
    left = [(rng.choice("abc"), rng.randint(0, 2000), i) for i in range(200)] + [("a", None, 200)]
    r = spark.createDataFrame(right, "k string, at int, v int")
    for lo in (spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame([], "k string, t int, id int")):
        whole = asof_join(lo, r, ["k"], "t", "at", ["v"])
        assert sorted(map(str, asof_join(lo, r, ["k"], "t", "at", ["v"], rows_a_slice=7).collect())) == sorted(map(str, whole.collect()))
    got = {x.id: x.v for x in asof_join(spark.createDataFrame(left, "k string, t int, id int"), r, ["k"], "t", "at", ["v"], rows_a_slice=7).collect()}
    for k, t, i in left[:-1]:
        seen = [(at, v) for own, at, v in right if own == k and at <= t]
        assert got[i] == (max(seen)[1] if seen else None)


def test_json_in_pieces(spark):
    for n, size in ((0, 2), (1, 2), (4, 2), (5, 2)):
        pieces = list(sqlapi.json_pieces(spark.range(n, numPartitions=3).selectExpr("id", "timestamp_seconds(id) AS t"), size))
        assert [r["id"] for r in json.loads("".join(pieces))] == list(range(n)) and len(pieces) == n // size + 1


def test_sql_text():
    sql, args = sqlapi.prepare("SELECT '$1 lp.x' FROM lp.cpu WHERE a = $1 AND b > now() - INTERVAL '5m' AND $__timeFilter(time)", [7], "2024-01-01", "2024-01-02")
    assert "'$1 lp.x'" in sql and "FROM cpu" in sql and "a = :p1" in sql and "INTERVAL '5 minute'" in sql and "BETWEEN TIMESTAMP'2024-01-01" in sql
    assert args == {"p1": 7}
    with pytest.raises(ValueError):
        sqlapi.prepare("SELECT $2", [1])
    assert sqlapi.named_tables("SELECT * FROM Cpu JOIN x", ["cpu", "mem"]) == ["cpu"]
