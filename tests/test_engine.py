from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidelake.engine import Config, Engine, EngineError
from tidelake.http import serve
from tidelake.operators.rollup import Rollup
from tidelake.sources.bulk import read_csv
from tidelake.sources.synthetic import synthetic_lines
from tidelake.streaming.batcher import Batcher
from tidelake.streaming.ingest import Schedule, ingest

T = 1_700_000_000_000_000_000
MINUTE = 60_000_000_000


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/root")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_write_and_merge_by_column(engine):
    done = engine.write(f"cpu,host=a value=1.5,count=3i {T}\nbad\n# note\n\ncpu,host=b value=2 {T}")
    assert (done.accepted, done.status, [e["line"] for e in done.errors]) == (2, 200, [2])
    assert engine.write(f"cpu,host=a value=9 {T}").status == 204
    # hot keeps the field that the second write lacks, cold the whole newest row
    assert rows(engine.relation("cpu"), "t_host", "f_value", "f_count") == [("a", 9.0, 3), ("b", 2.0, None)]
    assert rows(engine.relation("cpu", "cold"), "t_host", "f_value", "f_count") == [("a", 9.0, None), ("b", 2.0, None)]
    assert rows(engine.relation("cpu", "all"), "t_host", "f_count") == [("a", 3), ("b", None)]
    assert "seq" in engine.relation("cpu").columns and "seq" not in engine.relation("cpu", "all").columns


def test_a_field_of_the_batch_overwrites_with_null(engine):
    engine.write(f"m,h=a x=1,y=1 {T}")
    engine.write(f"m,h=a x=2 {T}\nm,h=b y=5 {T}")
    assert rows(engine.relation("m"), "t_h", "f_x", "f_y") == [("a", 2.0, None), ("b", None, 5.0)]


def test_last_line_wins_in_a_batch(engine):
    engine.write(f"m,h=a x=1,y=1 {T}\nm,h=a x=2 {T}")
    assert rows(engine.relation("m"), "f_x", "f_y") == [(2.0, None)]


def test_types_widen_and_history_follows(engine):
    for i, v in enumerate(("true", "3i", "2.5", '"text"', "0i")):
        engine.write(f"m v={v} {T + i * 1000}")
    assert engine.columns("m") == {"f_v": "string"}
    assert [r[0] for r in rows(engine.relation("m", "all"), "f_v")] == ["0", "2.5", "3", "True", "text"]
    assert Engine(engine.spark, engine.store.root).columns("m") == {"f_v": "string"}


def test_compaction_eviction_and_both_tiers(engine):
    engine.write(f"m,h=a v=1 {T}\nm,h=b v=2 {T + 86_400_000_000_000}")
    engine.write(f"m,h=a v=3 {T}")
    done = engine.compact("m")
    assert sum(d["rows"] for d in done) == 2 and len(done) == 2 and engine.compact("m") == []
    evicted = engine.evict("1 day", now="2023-12-01")
    assert len(evicted) == 2 and engine.evict("1 day", now="2023-12-01") == []
    assert engine.relation("m").count() == 0
    assert rows(engine.relation("m", "all"), "t_h", "f_v") == [("a", 3.0), ("b", 2.0)]
    assert {o["kind"] for o in engine.tier_status()["objects"]} == {"cold", "export"}


def test_the_window_prunes_objects_not_rows(engine):
    engine.write(f"m v=1 {T}\nm v=2 {T + MINUTE}")
    assert engine.relation("m", "cold", start="2023-11-14T22:14:00").count() == 2
    assert engine.relation("m", "cold", start="2024-01-01").count() == 0
    assert engine.relation("m", "all", start="2024-01-01").count() == 2  # never the hot tier


def test_delete_is_hot_only(engine):
    engine.write(f"m,h=a v=1 {T}\nm,h=a v=2 {T + MINUTE}\nm,h=b v=3 {T}\nm v=4 {T}")
    assert engine.delete("m", {"nope": "x"}) == 0 and engine.delete("unknown") == 0 and engine.tables() == ["m"]
    assert engine.delete("m", {"h": "a"}, "2023-11-14T22:13:20", "2023-11-14T22:14:20") == 1
    assert rows(engine.relation("m"), "f_v") == [(2.0,), (3.0,), (4.0,)]
    assert engine.relation("m", "all").count() == 4
    assert engine.delete("m") == 3 and engine.relation("m").count() == 0
    assert engine.show_chunks("m") == []


def test_fold_retain_export(engine, tmp_path):
    engine.write(f"m,h=a x=1 {T}")
    engine.write(f"m,h=a y=2 {T}")
    assert engine.fold("m") == 1 and engine.fold("m") == 0
    assert rows(engine.relation("m"), "f_x", "f_y") == [(1.0, 2.0)]
    assert engine.export_range("m", f"file://{tmp_path}/out", "2023-11-14", "2023-11-15") == 1
    assert engine.retain("1 day", now="2024-01-01") == 1 and engine.relation("m").count() == 0


def test_sql(engine):
    engine.write("\n".join(f"cpu,host=h{i % 2} value={i} {T + i * MINUTE}" for i in range(6)))
    assert json.loads(engine.query_json("SELECT t_host, count(*) AS n FROM lp.cpu WHERE t_host = $1 GROUP BY 1", ["h1"])) == [{"t_host": "h1", "n": 3}]
    got = json.loads(engine.query_json("SELECT time_bucket('1 hour', time) AS bucket, avg(f_value) AS v FROM lp.cpu GROUP BY bucket ORDER BY bucket DESC LIMIT 1", tier="all"))
    assert got == [{"bucket": "2023-11-14T22:00:00+00:00", "v": 2.5}]
    for bad in ({"sql": "SELEC 1"}, {"sql": "SELECT $1", "params": [1], "tier": "cold"}, {"sql": "SELECT 1", "tier": "warm"}):
        with pytest.raises(EngineError) as e:
            engine.query_json(**bad)
        assert e.value.status == 400
    with pytest.raises(EngineError) as e:
        Engine(engine.spark, engine.store.root, Config(query_engine=False)).query("SELECT * FROM cpu", tier="cold")
    assert e.value.status == 503


def test_bad_requests(engine):
    for body, precision in (("m v=1", "h"), ("  \n", "ns")):
        with pytest.raises(EngineError):
            engine.write(body, precision)
    assert engine.write("# only a note").status == 204
    assert engine.write("only bad").accepted == 0
    with pytest.raises(EngineError):
        engine.write(f"m,a\\ b=1,a_b=2 v=1 {T}")


def test_http(engine):
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, body.encode() if body is not None else None)) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        assert call("/api/v1/write", f"m,h=a v=1 {T}")[0] == 204
        assert json.loads(call("/api/v1/write?sync=true", f"m,h=b v=1 {T}\nbad")[1])["accepted"] == 1
        assert call("/api/v1/write?precision=h", "m v=1")[0] == call("/api/v1/write", "")[0] == 400
        assert json.loads(call("/api/v1/query", json.dumps({"sql": "SELECT count(*) AS n FROM lp.m"}))[1]) == [{"n": 2}]
        assert call("/api/v1/query?tier=cold&sql=SELECT%20count(*)%20AS%20n%20FROM%20m")[0] == 200
        assert json.loads(call("/api/v1/delete", json.dumps({"measurement": "m", "tags": {"h": "a"}}))[1]) == {"measurement": "m", "deleted": 1}
        assert call("/api/v1/delete", "{}")[0] == 400 and call("/nope")[0] == 404
        assert call("/api/v1/tier/run?older_than=1%20day", "")[0] == 200
        assert call("/api/v1/tier/status")[0] == call("/health")[0] == 200
    finally:
        server.shutdown()


def test_replayed_batch_changes_nothing(engine):
    from tidelake.sources import lineproto

    parsed = lineproto.parse_body(engine.spark, f"m,h=a v=1 {T}\nm,h=b v=2 {T}")
    for _ in range(2):
        engine.write_points(parsed, 1000)
    assert engine.relation("m").count() == engine.relation("m", "cold").count() == 2
    assert sum(o.rows for o in engine.manifest.objects("m", ["staging"])) == 2


def test_stream_equals_batch(engine, spark, tmp_path):
    lines = synthetic_lines(spark, "cpu", 200, 5)
    lines.coalesce(2).write.text(f"{tmp_path}/in")
    source = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in")
    ingest(engine, source, f"{tmp_path}/check", available_now=True).awaitTermination()
    other = Engine(spark, f"{tmp_path}/other")
    other.write("\n".join(r.line for r in lines.collect()))
    columns = ("time", "t_host", "t_region", "f_value", "f_count")
    assert rows(engine.relation("cpu"), *columns) == rows(other.relation("cpu"), *columns)
    assert engine.relation("cpu", "cold").count() == 200


def test_rollup_policy(spark, tmp_path):
    r = Rollup(spark, f"{tmp_path}/r", "1 minute", ["k"], {"v": "x"})
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 10:00:30' AS time, 'a' AS k, 2.0D AS x UNION ALL SELECT TIMESTAMP'2024-01-01 10:00:40', 'a', 4.0D")
    r.refresh_policy(df, "2024-01-01T10:30:00")
    assert [(x.k, x.v, x.n) for x in r.read().collect()] == [("a", 3.0, 2)]
    with pytest.raises(ValueError):
        Rollup(spark, "x", "7 hours", [], {})


def test_schedule_survives_errors():
    seen = []

    def job():
        seen.append(1)
        raise RuntimeError("no")

    s = Schedule(job, 0.01).start()
    while len(seen) < 2:
        pass
    s.stop()
    assert len(s.errors) >= 2




def test_bulk_load_of_csv(engine, spark, tmp_path):
    (tmp_path / "in.csv").write_text("time,sensor,location,temperature\n2024-01-01 10:00:00,1,kitchen,21.4\n2024-01-01 10:00:00,1,kitchen,21.5\n2024-01-01 10:01:00,2,,19\n")
    df = read_csv(spark, f"file://{tmp_path}/in.csv", "time timestamp, sensor int, location string, temperature double")
    assert engine.load(df, "sensors", ["sensor", "location"], ["temperature"], order="temperature") == 2
    assert rows(engine.relation("sensors", "all"), "t_sensor", "t_location", "f_temperature") == [("1", "kitchen", 21.5), ("2", None, 19.0)]
    assert engine.load(df.limit(0), "sensors", ["sensor"], ["temperature"]) == 0
    with pytest.raises(EngineError):
        engine.load(df.withColumn("time", F.lit(None).cast("timestamp")), "sensors", ["sensor"], ["temperature"])


def test_a_later_write_wins_over_a_load_of_many_partitions(engine, spark):
    df = spark.range(400, numPartitions=200).selectExpr("timestamp_seconds(1700000000 + id) AS time", "'h' || id AS host", "1.0D AS v")
    assert engine.load(df, "m", ["host"], ["v"]) == 400
    for i in (0, 399):  # rows of the first and of the last partition
        engine.write(f"m,host=h{i} v=2 {(1_700_000_000 + i) * 1_000_000_000}")
    for tier in ("hot", "cold", "all"):
        assert sorted(r.t_host for r in engine.relation("m", tier).where("f_v = 2").collect()) == ["h0", "h399"]
        assert engine.relation("m", tier).count() == 400


def test_writes_and_batches_of_a_stream_are_ordered_by_time(engine, spark, tmp_path):
    def batch(v, parts):
        spark.range(parts, numPartitions=parts).selectExpr(f"'m,h=a v={v},i=' || id || ' {T}' AS value").write.mode("append").text(f"{tmp_path}/in")
        ingest(engine, spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/check", available_now=True).awaitTermination()

    batch(1, 200)
    engine.write(f"m,h=a v=2 {T}")
    assert rows(engine.relation("m"), "f_v") == rows(engine.relation("m", "all"), "f_v") == [(2.0,)]
    batch(3, 2)
    assert rows(engine.relation("m"), "f_v") == rows(engine.relation("m", "cold"), "f_v") == [(3.0,)]


def test_two_instances_share_a_root(engine):
    other = Engine(engine.spark, engine.store.root)
    engine.write(f"m,h=a x=1i {T}")
    assert other.columns("m") == {"t_h": "string", "f_x": "bigint"}
    engine.write(f"m,h=a,zone=z extra=true,x=1.5 {T + 1000}")
    assert rows(other.relation("m", "all"), "t_zone", "f_extra", "f_x") == [("z", True, 1.5), (None, None, 1.0)]
    other.write(f"m,h=b x=7i {T}\nnew v=1 {T}")
    assert rows(engine.relation("m"), "t_h", "f_x") == [("a", 1.0), ("a", 1.5), ("b", 7.0)]
    assert json.loads(engine.query_json("SELECT count(*) AS n FROM lp.new")) == [{"n": 1}]
    other.write(f"m,h=a x=9i {T}")
    assert [r.f_x for r in engine.relation("m", "all").where(f"unix_micros(time) = {T // 1000} AND t_h = 'a'").collect()] == [9.0]


def test_the_log_folds_to_one_file(engine):
    for i in range(3):
        engine.write(f"m v={i} {T + i * MINUTE}")
    engine.compact("m")
    before = [(o.kind, o.object_key) for o in engine.manifest.objects()]
    assert engine.manifest.fold() > 2 and engine.manifest.fold() == 0
    assert [(o.kind, o.object_key) for o in engine.manifest.objects()] == before
    assert Engine(engine.spark, engine.store.root).relation("m", "all").count() == 3


def test_batches_by_size_or_age(engine):
    batcher = Batcher(engine, lines=3, seconds=600)
    start = time.monotonic()
    assert [batcher.put(f"m,h=a v={i} {T + i * 1000}") for i in range(2)] == [1, 1] and batcher.depth == 2
    batcher.put(f"m,h=b v=9 {T}\nbad")  # full: written at once
    while batcher.depth or engine.counters["written"] < 3:
        assert time.monotonic() - start < 100
        time.sleep(0.05)
    batcher.put(f"m,h=c v=1 {T // 10**6}", "ms")
    batcher.close()  # writes what waits
    assert rows(engine.relation("m"), "t_h") == [("a",), ("a",), ("b",), ("c",)] and engine.counters["failed"] == 1
    with pytest.raises(EngineError):
        batcher.put("m v=1")
    young = Batcher(engine, lines=1000, seconds=0.2)
    young.put(f"m,h=d v=1 {T}")
    while engine.counters["written"] < 5:
        assert time.monotonic() - start < 200
        time.sleep(0.05)
    young.close()
    for body, precision in (("", "ns"), ("m v=1", "h")):
        with pytest.raises(EngineError):
            young.put(body, precision)


def test_tier_run_folds_the_log(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/root", Config(log_files=4))
    for i in range(2):
        engine.write(f"m v={i} {T + i * MINUTE}")
    engine.tier_run("10000 days")
    assert len([x for x in engine.manifest.mark() if x.startswith("part-")]) == 1
    assert engine.relation("m", "all").count() == 2


def test_load_over_http(engine):
    from tidelake import loadgen
    from tidelake.sources.synthetic import synthetic_lines

    assert "\n".join(loadgen.bodies(25, 7, 10)).split("\n") == [r.line for r in synthetic_lines(engine.spark, "load", 25, 7).coalesce(1).collect()]
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = loadgen.run(f"http://127.0.0.1:{server.server_port}", 25, 7, 10, 2, verify=True)
    finally:
        server.shutdown()
    assert got["found"] == got["rows"] == 25 and got["rows_per_second"] > 0
