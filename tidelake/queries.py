"""The engine's queries over the driver's tables, by name, each with SQL of the same result.

``events`` is the measurement: ts is its time, event_type and user_id its tags, value and props.k its
fields and event_id its sequence number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Config, Engine
from .functions import lattice
from .functions.hashing import canonical_tags, hash_of
from .functions.naming import identifier_column
from .functions.time import padded, register_time_bucket, time_bucket, timestamp_of_ns, utc_day
from .operators.dedup import merge_columns, newest_by_seq, newest_rows
from .operators.intervals import covered_chunks, merge_intervals
from .operators.joins import asof_join, gapfill
from .operators.points import names_and_types
from .operators.rollup import Rollup, bucketed
from .plans.federation import lattice_types, union_by_name
from .plans.sqlapi import prepare
from .plans.tiering import compacted, eligible_chunks
from .sources import lineproto
from .sources.bulk import read_csv
from .sources.folders import shared_folder
from .sources.manifest import object_status, prune
from .sources.synthetic import synthetic_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, in a session whose zone is UTC."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a wide table."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("t_event_type"),
        F.col("user_id").cast("string").alias("t_user_id"),
        F.col("value").alias("f_value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("f_k"),
    )


def keyed(df: DataFrame) -> DataFrame:
    """With a key that is a function of the tags; the hash itself has a query of its own."""
    return df.withColumn("tag_hash", F.xxhash64("t_event_type", "t_user_id"))


def plain(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def rewritten(df: DataFrame) -> DataFrame:
    """A second version of every seventh row, newer and with another value."""
    return df.where("seq % 7 = 0").withColumn("f_value", F.col("f_value") + 1000).withColumn("seq", F.col("seq") + 1_000_000)


_V = "SELECT ts AS time, event_id AS seq, event_type AS t_event_type, user_id::VARCHAR AS t_user_id, value AS f_value, (props->>'$.k')::BIGINT AS f_k FROM events"
_W = f"v AS ({_V}), w AS (SELECT * REPLACE (f_value + 1000 AS f_value, seq + 1000000 AS seq) FROM v WHERE seq % 7 = 0)"


# buckets, projections and filters


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS bucket, event_type AS t_event_type, round(avg(value), 4) AS f_value, count(*) AS n FROM events GROUP BY 1, 2")
def bucket_avg_by_tag(spark, sf_dir):
    out = bucketed(measurement(spark, sf_dir), "1 minute", ["t_event_type"], {"f_value": "f_value"})
    return out.select(plain("bucket"), "t_event_type", F.round("f_value", 4).alias("f_value"), "n")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def bucket_top_n(spark, sf_dir):
    register_time_bucket(spark)
    measurement(spark, sf_dir).createOrReplaceTempView("tl_m")
    return spark.sql("SELECT cast(bucket AS TIMESTAMP_NTZ) AS bucket, n FROM (SELECT time_bucket('1 hour', time) AS bucket, count(*) AS n FROM tl_m GROUP BY 1 ORDER BY bucket DESC LIMIT 5)")


@query("SELECT time_bucket(INTERVAL '7 days', ts) AS week, time_bucket(INTERVAL '1 month', ts) AS month, time_bucket(INTERVAL '90 minutes', ts) AS part, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def bucket_week_and_month(spark, sf_dir):
    t = F.col("time")
    out = measurement(spark, sf_dir).groupBy(*[time_bucket(w, t).cast("timestamp_ntz").alias(n) for w, n in (("7 days", "week"), ("1 month", "month"), ("90 minutes", "part"))])
    return out.agg(F.count("*").alias("n"), F.sum(F.col("t_user_id").cast("bigint")).alias("users"))


@query("SELECT time_bucket(INTERVAL '5 months', o_orderdate) AS bucket, time_bucket(INTERVAL '1 year', o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL")
def bucket_sql_function(spark, sf_dir):
    register_time_bucket(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("tl_orders")
    return spark.sql("SELECT cast(time_bucket('5 months', cast(o_orderdate AS TIMESTAMP)) AS TIMESTAMP_NTZ) AS bucket, cast(time_bucket('1 year', cast(o_orderdate AS TIMESTAMP)) AS TIMESTAMP_NTZ) AS year, count(*) AS n FROM tl_orders GROUP BY ALL")


@query(f"WITH v AS ({_V}) SELECT * FROM v ORDER BY time DESC LIMIT 10")
def latest_n(spark, sf_dir):
    out = measurement(spark, sf_dir).orderBy(F.desc("time")).limit(10)
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"WITH v AS ({_V}) SELECT time, t_user_id AS who, f_value AS v FROM v WHERE t_event_type = 'click' AND time >= '2024-01-05' AND time < '2024-01-20'")
def tag_and_range(spark, sf_dir):
    m = measurement(spark, sf_dir)
    out = m.where((F.col("t_event_type") == "click") & (F.col("time") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("time") < F.lit("2024-01-20").cast("timestamp")))
    return out.select(plain("time"), F.col("t_user_id").alias("who"), F.col("f_value").alias("v"))


@query(f"WITH v AS ({_V}) SELECT t_event_type, count(*) AS n, min(time) AS first, max(time) AS last FROM v WHERE time BETWEEN '2024-01-03' AND '2024-01-09 12:00:00' GROUP BY 1")
def macro_time_filter(spark, sf_dir):
    measurement(spark, sf_dir).createOrReplaceTempView("tl_m")
    sql, _ = prepare("SELECT t_event_type, count(*) AS n, cast(min(time) AS TIMESTAMP_NTZ) AS first, cast(max(time) AS TIMESTAMP_NTZ) AS last FROM lp.tl_m WHERE $__timeFilter(time) GROUP BY 1", (), "2024-01-03", "2024-01-09T12:00:00")
    return spark.sql(sql)


@query(f"WITH v AS ({_V}) SELECT t_event_type, count(*) AS n, round(sum(f_value), 4) AS total FROM v WHERE f_k > 50 AND t_event_type <> 'view' GROUP BY 1")
def bound_parameters(spark, sf_dir):
    measurement(spark, sf_dir).createOrReplaceTempView("tl_m")
    sql, args = prepare("SELECT t_event_type, count(*) AS n, round(sum(f_value), 4) AS total FROM lp.tl_m WHERE f_k > $1 AND t_event_type <> $2 GROUP BY 1", [50, "view"])
    return spark.sql(sql, args=args)


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL '5 days' GROUP BY 1")
def recent_interval(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("tl_events")
    sql, _ = prepare("SELECT event_type, count(*) AS n FROM tl_events WHERE ts > TIMESTAMP_NTZ'2024-01-31' - INTERVAL '5d' GROUP BY 1")
    return spark.sql(sql)


# versions


@query(f"WITH {_W}, u AS (SELECT * FROM v UNION ALL SELECT * FROM w) SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY time, t_event_type, t_user_id ORDER BY seq DESC) AS _rn FROM u) WHERE _rn = 1")
def batch_last_wins(spark, sf_dir):
    m = measurement(spark, sf_dir)
    out = newest_rows(m.unionByName(rewritten(m)), [F.desc("seq")], ["time"])
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"WITH {_W}, u AS (SELECT * EXCLUDE (f_k) FROM w UNION ALL BY NAME SELECT * FROM v) SELECT * EXCLUDE (_rn, seq) FROM (SELECT *, row_number() OVER (PARTITION BY time, t_event_type, t_user_id ORDER BY seq DESC) AS _rn FROM u) WHERE _rn = 1")
def cross_tier_newest(spark, sf_dir):
    m = keyed(measurement(spark, sf_dir))
    hot = rewritten(m).drop("f_k")
    types = lattice_types([m, hot])
    out = newest_by_seq(union_by_name([hot.withColumn("_rank", F.lit(3)), m.withColumn("_rank", F.lit(0))], types))
    return out.drop("seq", "_rank", "tag_hash").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"WITH v AS ({_V}), u AS (SELECT *, 0 AS r FROM v UNION ALL SELECT * REPLACE (-f_value AS f_value), 3 AS r FROM v WHERE seq % 3 = 0 UNION ALL SELECT * REPLACE (0 AS f_value), 1 AS r FROM v WHERE seq % 2 = 0) SELECT time, t_event_type, t_user_id, f_value FROM (SELECT *, row_number() OVER (PARTITION BY time, t_event_type, t_user_id ORDER BY seq DESC, r DESC) AS _rn FROM u) WHERE _rn = 1")
def equal_seq_hot_first(spark, sf_dir):
    m = keyed(measurement(spark, sf_dir))
    hot = m.where("seq % 3 = 0").withColumn("f_value", -F.col("f_value")).withColumn("_rank", F.lit(3))
    cold = m.where("seq % 2 = 0").withColumn("f_value", F.lit(0.0)).withColumn("_rank", F.lit(1))
    out = newest_by_seq(m.withColumn("_rank", F.lit(0)).unionByName(hot).unionByName(cold))
    return out.select(plain("time"), "t_event_type", "t_user_id", "f_value")


@query(f"""WITH v AS ({_V}), u AS (
    SELECT time, seq, t_event_type, t_user_id, f_value, f_k, true AS a, true AS b FROM v
    UNION ALL SELECT time, seq + 1000000, t_event_type, t_user_id, f_value + 1, NULL, true, false FROM v WHERE seq % 2 = 0
    UNION ALL SELECT time, seq + 2000000, t_event_type, t_user_id, NULL, NULL, false, true FROM v WHERE seq % 6 = 0)
    SELECT time, t_event_type, t_user_id, max(seq) AS seq, arg_max_null(f_value, seq) FILTER (WHERE a) AS f_value, arg_max_null(f_k, seq) FILTER (WHERE b) AS f_k FROM u GROUP BY 1, 2, 3""")
def column_merge_upsert(spark, sf_dir):
    m = keyed(measurement(spark, sf_dir))
    cols = lambda *c: F.array(*map(F.lit, c))
    first = m.withColumn("_cols", cols("f_value", "f_k"))
    second = m.where("seq % 2 = 0").withColumn("seq", F.col("seq") + 1_000_000).withColumn("f_value", F.col("f_value") + 1).withColumn("f_k", F.lit(None).cast("bigint")).withColumn("_cols", cols("f_value"))
    third = m.where("seq % 6 = 0").withColumn("seq", F.col("seq") + 2_000_000).withColumn("f_value", F.lit(None).cast("double")).withColumn("f_k", F.lit(None).cast("bigint")).withColumn("_cols", cols("f_k"))
    out = merge_columns(first.unionByName(second).unionByName(third), ["f_value", "f_k"])
    return out.drop("tag_hash").withColumn("time", F.col("time").cast("timestamp_ntz"))


# tiers


@query(f"WITH {_W}, u AS (SELECT * FROM v UNION ALL SELECT * FROM w), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY time, t_event_type, t_user_id ORDER BY seq DESC) AS _rn FROM u) WHERE _rn = 1) SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS rows, min(seq) AS min_seq, max(seq) AS max_seq, round(sum(f_value), 4) AS total FROM d GROUP BY 1")
def compaction_by_day(spark, sf_dir):
    m = keyed(measurement(spark, sf_dir))
    out = compacted(m.unionByName(rewritten(m)).withColumn("_rank", F.lit(0)))
    return out.groupBy(utc_day(F.col("time")).alias("day")).agg(F.count("*").alias("rows"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.round(F.sum("f_value"), 4).alias("total"))


@query("""WITH a AS (SELECT event_id, event_id % 2 = 0 AS flag, event_id % 5 AS num, value AS txt FROM events WHERE event_id % 3 = 0),
    b AS (SELECT event_id, event_id % 7 AS flag, value AS num, event_type AS txt FROM events WHERE event_id % 3 <> 0)
    SELECT event_id, flag::INT::BIGINT AS flag, num::DOUBLE AS num, NULL AS extra, txt IS NULL AS no_text FROM a
    UNION ALL SELECT event_id, flag::BIGINT, num, event_id, txt IS NULL FROM b""")
def lattice_union(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_id % 3 = 0").select("event_id", (F.col("event_id") % 2 == 0).alias("flag"), (F.col("event_id") % 5).alias("num"), F.col("value").alias("txt"))
    b = e.where("event_id % 3 <> 0").select("event_id", (F.col("event_id") % 7).alias("flag"), F.col("value").alias("num"), F.col("event_type").alias("txt"), F.col("event_id").alias("extra"))
    return union_by_name([a, b], lattice_types([a, b])).select("event_id", "flag", "num", "extra", F.col("txt").isNull().alias("no_text"))


_OBJECTS = "o AS (SELECT event_type AS measurement, CASE WHEN event_id % 4 = 0 THEN 'staging' ELSE 'cold' END AS kind, strftime(ts, '%Y-%m-%d') AS object_key, min(ts) AS range_start, max(ts) AS range_end, count(*) AS rows, min(event_id) AS min_seq FROM events GROUP BY 1, 2, 3)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest as it might stand: an object per measurement, kind and day."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("event_type").alias("measurement"), F.when(F.col("event_id") % 4 == 0, "staging").otherwise("cold").alias("kind"), utc_day(F.col("ts")).alias("object_key")).agg(F.min("ts").alias("range_start"), F.max("ts").alias("range_end"), F.count("*").alias("rows"), F.min("event_id").alias("min_seq"))


@query(f"WITH {_OBJECTS} SELECT measurement, kind, object_key, rows, min_seq FROM o WHERE range_end >= '2024-01-08' AND range_start <= '2024-01-12 06:00:00'")
def manifest_pruning(spark, sf_dir):
    return prune(objects(spark, sf_dir), "2024-01-08", "2024-01-12T06:00:00").select("measurement", "kind", "object_key", "rows", "min_seq")


@query(f"WITH {_OBJECTS} SELECT measurement, kind, count(*) AS objects, sum(rows)::BIGINT AS rows, min(range_start) AS range_start, max(range_end) AS range_end FROM o GROUP BY 1, 2")
def manifest_status(spark, sf_dir):
    return object_status(objects(spark, sf_dir)).select("measurement", "kind", "objects", "rows", plain("range_start"), plain("range_end"))


@query(f"WITH {_OBJECTS} SELECT DISTINCT measurement FROM o ORDER BY 1")
def manifest_measurements(spark, sf_dir):
    return objects(spark, sf_dir).select("measurement").distinct().orderBy("measurement")


_SPANS = "s AS (SELECT event_type AS measurement, ts AS range_start, ts + INTERVAL 36 MINUTE AS range_end FROM events), m AS (SELECT *, max(range_end) OVER (PARTITION BY measurement ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s), i AS (SELECT *, sum(CASE WHEN range_start <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY measurement ORDER BY range_start, range_end ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT measurement, min(range_start) AS range_start, max(range_end) AS range_end, count(*) AS n FROM i GROUP BY measurement, island)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of 36 minutes for each event."""
    t = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("measurement"), t.alias("range_start"), (t + F.expr("INTERVAL '36' MINUTE")).alias("range_end"))


@query(f"WITH {_SPANS} SELECT * FROM g")
def interval_islands(spark, sf_dir):
    return merge_intervals(spans(spark, sf_dir), ["measurement"]).select("measurement", plain("range_start"), plain("range_end"), "n")


_CHUNKS = "c AS (SELECT DISTINCT event_type AS measurement, time_bucket(INTERVAL '4 hours', ts) AS chunk_start, time_bucket(INTERVAL '4 hours', ts) + INTERVAL 4 HOUR AS chunk_end FROM events)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = time_bucket("4 hours", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("measurement"), start.alias("chunk_start"), (start + F.expr("INTERVAL '4' HOUR")).alias("chunk_end")).distinct()


@query(f"WITH {_SPANS}, {_CHUNKS} SELECT measurement, chunk_start, chunk_end, EXISTS (SELECT 1 FROM g WHERE g.measurement = c.measurement AND g.range_start <= c.chunk_start AND g.range_end >= c.chunk_end) AS covered FROM c")
def chunk_coverage(spark, sf_dir):
    return covered_chunks(chunks(spark, sf_dir), spans(spark, sf_dir), ["measurement"]).select("measurement", plain("chunk_start"), plain("chunk_end"), "covered")


@query(f"WITH {_CHUNKS} SELECT measurement, count(*) AS n, max(chunk_end) AS last FROM c WHERE chunk_end <= TIMESTAMP '2024-01-31' - INTERVAL '7 days' GROUP BY 1")
def eviction_eligible(spark, sf_dir):
    out = eligible_chunks(chunks(spark, sf_dir), "2024-01-31", "7 days")
    return out.groupBy("measurement").agg(F.count("*").alias("n"), F.max("chunk_end").cast("timestamp_ntz").alias("last"))


# the engine itself, over a root of its own


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidelake-{name}-{uuid.uuid4().hex}"


def _new_engine(spark: SparkSession, config: Config | None = None) -> Engine:
    return Engine(spark, _folder(spark, "root"), config)


def _engine(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Engine:
    """A store filled from events through line protocol, and rewritten in part."""
    engine = _new_engine(spark, config)
    m = measurement(spark, sf_dir)
    for version in (m, rewritten(m)):
        lines = lineproto.to_lines(version, "events", {"event_type": "t_event_type", "user_id": "t_user_id"}, {"value": "f_value", "k": "f_k"})
        numbered = lines.select(F.monotonically_increasing_id().alias("ordinal"), F.lit(None).cast("bigint").alias("line_no"), "line")
        engine.write_points(lineproto.parse_lines(numbered))
    return engine


_LAST = f"WITH {_W} SELECT v.time, v.t_event_type, v.t_user_id, coalesce(w.f_value, v.f_value) AS f_value, v.f_k FROM v LEFT JOIN w USING (time, t_event_type, t_user_id)"


@query(_LAST)
def engine_round_trip(spark, sf_dir):
    out = _engine(spark, sf_dir).relation("events")
    return out.select(plain("time"), "t_event_type", "t_user_id", "f_value", "f_k")


@query(f"WITH v AS ({_V}) SELECT time, t_event_type, t_user_id, max(f_value) AS f_value FROM (SELECT * FROM v UNION ALL SELECT * REPLACE (f_value + 5000 AS f_value) FROM v WHERE seq % 5 = 0) GROUP BY ALL")
def engine_bulk_load(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type", "user_id", "value")
    again = table(spark, sf_dir, "events").where("event_id % 5 = 0").select("ts", "event_type", "user_id", (F.col("value") + 5000).alias("value"))
    engine = _new_engine(spark)
    engine.load(e.unionByName(again), "events", ["event_type", "user_id"], ["value"], "ts", "value")
    return engine.relation("events").select(plain("time"), "t_event_type", "t_user_id", "f_value")


@query(_LAST)
def engine_compacted_and_evicted(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.tier_run("10 days", now="2024-02-01")
    return engine.relation("events", "all").select(plain("time"), "t_event_type", "t_user_id", "f_value", "f_k")


@query(f"WITH l AS ({_LAST}) SELECT time_bucket(INTERVAL '1 day', time) AS bucket, t_event_type, round(avg(f_value), 4) AS v, count(*) AS n FROM l WHERE t_event_type = 'click' GROUP BY 1, 2")
def engine_sql_all_tiers(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.compact()
    return engine.query("SELECT cast(time_bucket('1 day', time) AS TIMESTAMP_NTZ) AS bucket, t_event_type, round(avg(f_value), 4) AS v, count(*) AS n FROM lp.events WHERE t_event_type = 'click' GROUP BY 1, 2", tier="all")


@query(f"WITH l AS ({_LAST}) SELECT time, t_event_type, t_user_id, f_value, f_k FROM l WHERE NOT (t_event_type = 'click' AND time >= '2024-01-05' AND time < '2024-01-15')")
def engine_delete_survivors(spark, sf_dir):
    engine = _engine(spark, sf_dir, Config(write_through=False, chunk="7 days"))
    engine.delete("events", {"event_type": "click"}, "2024-01-05", "2024-01-15")
    return engine.relation("events").select(plain("time"), "t_event_type", "t_user_id", "f_value", "f_k")


@query(f"WITH l AS ({_LAST}) SELECT time, t_event_type, t_user_id, f_value, f_k FROM l WHERE time >= '2024-01-10' AND time < '2024-01-20'")
def engine_export_range(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    path = engine.store.path("export")
    engine.export_range("events", path, "2024-01-10", "2024-01-20")
    return spark.read.parquet(path).select(plain("time"), "t_event_type", "t_user_id", "f_value", "f_k")


@query(f"WITH v AS ({_V}) SELECT time, t_event_type, t_user_id, CASE WHEN seq % 50 = 0 THEN -1.0 ELSE f_value END AS f_value FROM v")
def engine_load_then_write(spark, sf_dir):
    """A write after a load of many partitions wins, whatever the partition of its rows."""
    engine = _new_engine(spark)
    engine.load(table(spark, sf_dir, "events").repartition(64), "events", ["event_type", "user_id"], ["value"], "ts")
    m = measurement(spark, sf_dir).where("seq % 50 = 0").withColumn("f_value", F.lit(-1.0))
    lines = lineproto.to_lines(m, "events", {"event_type": "t_event_type", "user_id": "t_user_id"}, {"value": "f_value"})
    engine.write_points(lineproto.parse_lines(lines.select(F.monotonically_increasing_id().alias("ordinal"), F.lit(None).cast("bigint").alias("line_no"), "line")))
    return engine.relation("events", "all").select(plain("time"), "t_event_type", "t_user_id", "f_value")


@query(f"WITH v AS ({_V}) SELECT time, t_event_type, t_user_id, f_value, f_k FROM v")
def engine_two_instances(spark, sf_dir):
    """What one instance adds, a column too, another one of the same root reads."""
    first = _new_engine(spark, Config(chunk="7 days"))
    second = Engine(spark, first.store.root, first.config)
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    first.load(e.where("event_id % 2 = 0").drop("k"), "events", ["event_type", "user_id"], ["value"], "ts")
    second.columns("events")
    first.load(e, "events", ["event_type", "user_id"], ["value", "k"], "ts")
    return second.relation("events", "all").select(plain("time"), "t_event_type", "t_user_id", "f_value", "f_k")


@query(f"WITH v AS ({_V}) SELECT time, t_event_type, t_user_id, f_value FROM v")
def bulk_csv_load(spark, sf_dir):
    path = _folder(spark, "csv")
    table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), "event_type", "user_id", "value").write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    engine = _new_engine(spark, Config(chunk="7 days"))
    engine.load(read_csv(spark, path, "time timestamp, event_type string, user_id bigint, value double"), "events", ["event_type", "user_id"], ["value"])
    return engine.relation("events").select(plain("time"), "t_event_type", "t_user_id", "f_value")


@query(f"WITH v AS ({_V}) SELECT time, t_event_type, t_user_id, f_value FROM v WHERE time >= TIMESTAMP '2024-02-01' - INTERVAL '10 days'")
def engine_retention(spark, sf_dir):
    engine = _new_engine(spark, Config(write_through=False))
    engine.load(table(spark, sf_dir, "events"), "events", ["event_type", "user_id"], ["value"], "ts")
    engine.retain("10 days", now="2024-02-01")
    return engine.relation("events").select(plain("time"), "t_event_type", "t_user_id", "f_value")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS chunk_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS chunk_end, 1 AS objects, count(DISTINCT (ts, event_type, user_id)) AS rows FROM events GROUP BY 1, 2")
def engine_show_chunks(spark, sf_dir):
    engine = _new_engine(spark, Config(write_through=False))
    engine.load(table(spark, sf_dir, "events"), "events", ["event_type", "user_id"], ["value"], "ts")
    chunks_ = [(c["chunk_start"].replace(tzinfo=None), c["chunk_end"].replace(tzinfo=None), c["objects"], c["rows"]) for c in engine.show_chunks("events")]
    return spark.createDataFrame(chunks_, "chunk_start timestamp_ntz, chunk_end timestamp_ntz, objects int, rows bigint")


@query("SELECT 1 AS step, count(*) FILTER (event_type = 'click' AND ts < '2024-01-15') AS n FROM events UNION ALL SELECT 2, count(*) FILTER (NOT (event_type = 'click' AND ts < '2024-01-15')) FROM events UNION ALL SELECT 3, 0 UNION ALL SELECT 4, count(*) FROM events UNION ALL SELECT 5, 0")
def engine_delete_counts(spark, sf_dir):
    """Deleted rows: of a tag and range, of the rest, of nothing; then what cold still has, and what a window without objects has."""
    engine = _new_engine(spark, Config(chunk="7 days"))
    engine.load(table(spark, sf_dir, "events"), "events", ["event_type", "user_id"], ["value"], "ts")
    n = [engine.delete("events", {"event_type": "click"}, end="2024-01-15"), engine.delete("events"), engine.delete("events")]
    n += [engine.relation("events", "all").count(), engine.relation("events", "cold", start="2030-01-01").count()]
    return spark.createDataFrame(list(enumerate(n, 1)), "step int, n bigint")


@query("SELECT event_type AS t_event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events GROUP BY 1")
def engine_json_rows(spark, sf_dir):
    engine = _new_engine(spark, Config(chunk="7 days"))
    engine.load(table(spark, sf_dir, "events"), "events", ["event_type", "user_id"], ["value"], "ts")
    rows = json.loads(engine.query_json("SELECT t_event_type, count(*) AS n, max(time) AS last FROM lp.events GROUP BY 1", tier="all"))
    return spark.createDataFrame([(r["t_event_type"], r["n"], r["last"][:19]) for r in rows], "t_event_type string, n bigint, last string")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM events")
def json_functions(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("tl_events")
    return spark.sql("SELECT event_id, from_json(props, 'k BIGINT').k AS k, get_json_object(props, '$.none') IS NULL AS missing FROM tl_events")


# parsing and functions


@query("SELECT ts AS time, event_type AS t_event_type, user_id::VARCHAR AS t_user_id, value AS f_value, (props->>'$.k')::BIGINT AS f_k, event_type || ' \"x, y\" ' || event_id AS f_note FROM events")
def line_protocol_round_trip(spark, sf_dir):
    m = measurement(spark, sf_dir).withColumn("f_note", F.concat("t_event_type", F.lit(' "x, y" '), F.col("seq").cast("string")))
    lines = lineproto.to_lines(m, "events", {"event_type": "t_event_type", "user_id": "t_user_id"}, {"value": "f_value", "k": "f_k", "note": "f_note"})
    p = lineproto.parse_lines(lines.select(F.lit(0).cast("bigint").alias("ordinal"), F.lit(1).cast("bigint").alias("line_no"), "line")).where("error IS NULL")
    return p.select(plain("time"), *[F.col("tags")[t].alias(f"t_{t}") for t in ("event_type", "user_id")], F.col("fields")["value"]["d"].alias("f_value"), F.col("fields")["k"]["i"].alias("f_k"), F.col("fields")["note"]["s"].alias("f_note"))


@query("SELECT * FROM (VALUES (2, 'at least one field required'), (5, 'empty field value'), (6, 'missing measurement'), (7, 'invalid timestamp: ''x''')) t(line_no, error)")
def parse_errors(spark, sf_dir):
    body = "cpu,host=a v=1 1700000000000000000\ncpu,host=a ,\n# comment\n\ncpu v=\n,host=a v=1\ncpu v=1 x\ncpu v=2i"
    return lineproto.parse_body(spark, body).where("error IS NOT NULL").select(F.col("line_no").cast("int").alias("line_no"), "error")


@query("SELECT event_id, ts AS time FROM events")
def ns_to_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", timestamp_of_ns(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("timestamp_ntz").alias("time"))


@query("SELECT count(DISTINCT (event_type, user_id)) AS series, count(DISTINCT (event_type, user_id)) AS hashes, true AS in_range FROM events")
def tag_hash_series(spark, sf_dir):
    tags = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    h = table(spark, sf_dir, "events").select(canonical_tags(tags).alias("c"), hash_of(tags).alias("h"))
    return h.agg(F.count_distinct("c").alias("series"), F.count_distinct("h").alias("hashes"), F.bool_and((F.col("h") >= 0)).alias("in_range"))


@query("SELECT event_type AS measurement, 'field' AS kind, 'v' AS name, max(CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END) AS rank FROM events GROUP BY 1 UNION ALL SELECT DISTINCT event_type, 'tag', 'user', 3 FROM events")
def names_and_widest_types(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 11 == 0, "double").otherwise("bigint")
    value = F.struct(kind.alias("type"), F.lit(None).cast("boolean").alias("b"), F.col("event_id").alias("i"), F.col("value").alias("d"), F.lit(None).cast("string").alias("s"))
    points = e.select(F.col("event_type").alias("measurement"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), F.create_map(F.lit("v"), value).alias("fields"))
    return names_and_types(points)


@query("SELECT range AS i, 'h' || (range % 50) AS host, 'r' || (range % 50 % 8) AS region, (range % 1000) / 10.0::DOUBLE AS value, range % 100 AS count, 1700000000000000000 + range * 1000000000 AS ts_ns FROM range(5000)")
def synthetic_source(spark, sf_dir):
    return synthetic_points(spark, 5000, 50)


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, lpad((event_id - event_id % 100)::VARCHAR, 20, '0') AS key FROM events")
def days_and_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(utc_day(F.col("ts").cast("timestamp")).alias("day"), padded(F.col("event_id") - F.col("event_id") % 100).alias("key")).distinct()


@query("SELECT DISTINCT CASE WHEN regexp_matches(c, '^[a-z_]') THEN c ELSE '_' || c END AS name FROM (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g')) AS c FROM part)")
def identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select(identifier_column(F.col("p_name")).alias("name")).distinct()


@query("SELECT event_id, (event_id % 2 = 0)::INT::DOUBLE AS as_double, event_id::VARCHAR AS as_text, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS bool_text FROM events")
def coercions(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").select("event_id", lattice.widen(even, "boolean", "double").alias("as_double"), lattice.widen(F.col("event_id"), "bigint", "string").alias("as_text"), lattice.widen(even, "boolean", "string").alias("bool_text"))


# rollups and what passes through to SQL


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, event_type AS t_event_type, round(avg(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2")
def rollup_refreshed(spark, sf_dir):
    m = measurement(spark, sf_dir)
    rollup = Rollup(spark, _folder(spark, "rollup"), "15 minutes", ["t_event_type"], {"v": "f_value"})
    day = F.date_trunc("day", "time")
    text = lambda c: c.cast("string")
    start, middle, end = m.agg(text(F.min(day)), text(F.timestamp_micros(((F.unix_micros(F.min(day)) + F.unix_micros(F.max(day))) / 2).cast("bigint"))), text(F.max(day) + F.expr("INTERVAL '1' DAY"))).first()
    rollup.refresh(m.withColumn("f_value", F.lit(0.0)), start, end)
    rollup.refresh(m, start, middle)  # and again what has changed
    rollup.refresh(m, middle, end)
    return rollup.read().select(plain("bucket"), "t_event_type", F.round("v", 4).alias("v"), "n")


@query("WITH b AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, round(sum(value), 4) AS total FROM events GROUP BY 1, 2), g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-02 23:00:00', INTERVAL '1 hour')) AS bucket) SELECT t.event_type, g.bucket, b.total FROM (SELECT DISTINCT event_type FROM b) t CROSS JOIN g LEFT JOIN b ON b.event_type = t.event_type AND b.bucket = g.bucket")
def gap_filled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hours = e.groupBy("event_type", time_bucket("1 hour", F.col("ts").cast("timestamp")).alias("bucket")).agg(F.round(F.sum("value"), 4).alias("total"))
    return gapfill(hours, "bucket", "1 hour", ["event_type"], "2024-01-02", "2024-01-03").select("event_type", plain("bucket"), "total")


@query("SELECT o_orderkey, o_orderdate, e.event_id, e.value FROM orders o ASOF LEFT JOIN (SELECT user_id % 10 AS k, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) e ON o.o_custkey % 10 = e.k AND o.o_orderdate + INTERVAL '9490 days' >= e.ts")
def as_of_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 10).alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL '9490' DAY")).alias("at"))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("k"), "ts", "event_id", "value")
    return asof_join(o, e, ["k"], "at", "ts", ["event_id", "value"]).select("o_orderkey", "o_orderdate", "event_id", "value")


def passed(name: str, sql: str) -> None:
    """SQL that both engines take as it is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


passed("sql_joins", "SELECT n_name, r_name, count(*) AS n, count(o_orderkey) AS orders FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, r_name")
passed("sql_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1) b ON a.k = b.k")
passed("sql_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
passed("sql_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
passed("sql_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
passed("sql_range_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 1000")
passed("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
passed("sql_rollup_having", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id) HAVING count(*) > 3")
passed("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
passed("sql_distinct_aggregates", "SELECT event_type, count(DISTINCT user_id) AS users, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
passed("sql_first_and_last", "SELECT event_type, min_by(value, ts) AS first, max_by(value, ts) AS last FROM events GROUP BY event_type")
passed("sql_windows", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS r, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS previous, cast(sum(event_id) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bigint) AS s FROM events")
passed("sql_ordered_sets", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS middle, cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY user_id) AS double) AS high, count(*) FILTER (WHERE value > 50) AS n FROM events GROUP BY event_type")
passed("sql_approximate", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type")
passed("sql_strings", "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 5) AS part, replace(c_name, '#', '-') AS r, cast(length(c_name) AS bigint) AS n, concat(c_mktsegment, '/', c_custkey) AS c, lpad(cast(c_custkey AS string), 8, '0') AS p, CASE WHEN c_name LIKE '%1%' THEN 'one' ELSE 'none' END AS has, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS s FROM customer")
passed("sql_set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 EXCEPT SELECT s_nationkey FROM supplier)")
passed("sql_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus")


# streams, run to the end of their input


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, round(avg(value), 4) AS v, count(*) AS n FROM events WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2")
def stream_rollup(spark, sf_dir):
    from .streaming.ingest import rollup_stream

    e = table(spark, sf_dir, "events")
    base = _folder(spark, "stream")
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    out = rollup_stream(rows, "1 hour", "10 minutes", ["event_type"], {"v": "value"}, "ts")
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select(plain("bucket"), "event_type", F.round("v", 4).alias("v"), "n")


@query(_LAST)
def stream_ingest(spark, sf_dir):
    from .streaming.ingest import ingest

    m = measurement(spark, sf_dir)
    base = _folder(spark, "stream")
    engine = Engine(spark, f"{base}/root", Config(chunk="7 days"))
    for i, version in enumerate((m, rewritten(m))):
        lineproto.to_lines(version, "events", {"event_type": "t_event_type", "user_id": "t_user_id"}, {"value": "f_value", "k": "f_k"}).coalesce(1).write.mode("append").text(f"{base}/in")
        ingest(engine, spark.readStream.text(f"{base}/in"), f"{base}/check", available_now=True).awaitTermination()
    return engine.relation("events").select(plain("time"), "t_event_type", "t_user_id", "f_value", "f_k")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bucket_avg_by_tag"](spark, sf_dir)


