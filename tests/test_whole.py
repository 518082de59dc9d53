"""That queries and operators take all of their input."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from tidelake.engine import Engine
from tidelake.queries import QUERIES
from tidelake.streaming.ingest import ingest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@needs_data
def test_as_of_join_takes_every_order(spark):
    got = QUERIES["as_of_join"](spark, DATA).select("o_orderkey").toPandas()["o_orderkey"]
    want = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").toPandas()["o_orderkey"]
    assert sorted(got) == sorted(want)


def test_islands_and_coverage_take_every_user(spark, tmp_path):
    day = datetime(2024, 1, 1)
    # no user is a multiple of five; together they fill the first chunk of four hours and not the second
    rows = [(day + timedelta(minutes=30 * i), "click", i % 4 + 1) for i in range(10)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    islands = QUERIES["interval_islands"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in islands] == [("click", day, day + timedelta(minutes=306), 10)]
    covered = {r.chunk_start: r.covered for r in QUERIES["chunk_coverage"](spark, str(tmp_path)).collect()}
    assert covered == {day: True, day + timedelta(hours=4): False}


def test_every_error_is_returned_and_counted(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/root")
    bad = ["bad"] * 1500
    done = engine.write("\n".join([*bad, "cpu v=1 1700000000000000000"]))
    assert (done.accepted, done.failed) == (1, 1500)
    assert [e["line"] for e in done.errors] == list(range(1, 1501))
    spark.createDataFrame([(b,) for b in bad], "value string").write.text(f"{tmp_path}/in")
    ingest(engine, spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/check", available_now=True).awaitTermination()
    assert engine.counters["failed"] == 1500
    kept = spark.read.parquet(f"{tmp_path}/root/_errors/*")
    assert kept.count() == 1500 and kept.where("error IS NULL").count() == 0
    assert engine.relation("cpu").count() == 1


def test_rollup_takes_every_day(spark, tmp_path):
    days = [datetime(2023, 12, 30, 5), datetime(2024, 1, 9, 23, 59), datetime(2024, 1, 20), datetime(2024, 2, 1), datetime(2024, 3, 2, 23, 59, 59, 999999)]
    rows = [(i, d, "click", i, float(i + 1), '{"k": 1}') for i, d in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, user_id long, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["rollup_refreshed"](spark, str(tmp_path)).collect()
    assert sorted((r.bucket.date(), r.v, r.n) for r in got) == [(d.date(), float(i + 1), 1) for i, d in enumerate(days)]
