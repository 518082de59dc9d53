"""The engine: write, query, delete, tier. One instance owns a root folder."""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import chain

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lattice
from .functions.hashing import with_hash_of_columns
from .functions.naming import distinct_columns, field_column, identifier, tag_column
from .functions.time import PRECISION_NS, as_utc, parse_width, register_time_bucket
from .operators.dedup import newest_by_seq
from .operators.intervals import covers, islands
from .operators.points import names_and_types, wide_rows
from .plans import federation, sqlapi, tiering
from .sources import lineproto
from .sources.manifest import Manifest, ObjectMeta, Store, staging_key

TIERS = ("hot", "cold", "all")
COLD = ("staging", "cold", "export")


class EngineError(Exception):
    """A request that can't be served, with the status that HTTP gives it."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


@dataclass
class Config:
    chunk: str = "1 day"
    hot_window: str = "7 days"
    write_through: bool = True
    query_engine: bool = True
    compact_target_bytes: int = tiering.TARGET_BYTES
    log_files: int = 64
    schema: str = "lp"


@dataclass
class WriteResult:
    accepted: int
    errors: list[dict]
    failed: int = 0  # bad lines, whether they are in errors or in the table at errors_path
    errors_path: str | None = None

    @property
    def status(self) -> int:
        return 200 if self.failed else 204


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, root)
        self.manifest = Manifest(self.store)
        self._schemas: dict[str, dict[str, str]] = {}
        self._schemas_at: object = None
        self._locks: defaultdict[str, threading.RLock] = defaultdict(threading.RLock)
        self.counters = {"written": 0, "failed": 0}
        self._chunk = timedelta(microseconds=parse_width(self.config.chunk)[1])

    # schemas

    def _registry(self) -> dict[str, dict[str, str]]:
        """Table -> column -> type: what this instance has seen, and the widest types of the live objects, whoever wrote them."""
        mark = self.manifest.mark()
        if mark != self._schemas_at:
            for r in self.manifest.live().select("measurement", "columns").distinct().collect():
                self._learn(r.measurement, json.loads(r.columns))
            self._schemas_at = mark
        return self._schemas

    def _learn(self, table: str, columns: dict[str, str]) -> dict[str, str]:
        """Add and widen columns of a table; returns all of them."""
        own = self._schemas.setdefault(table, {})
        for c, t in columns.items():
            if c != "_cols":
                own[c] = lattice.widest([own[c], t]) if c in own else t
        return own

    def columns(self, measurement: str) -> dict[str, str]:
        """Tag and field columns of a table, in order of name."""
        return self._ordered(self._registry().get(identifier(measurement), {}))

    @staticmethod
    def _ordered(columns: dict[str, str]) -> dict[str, str]:
        return dict(sorted(columns.items(), key=lambda x: (x[0][0] != "t", x[0])))

    def tables(self) -> list[str]:
        return sorted(self._registry())

    def _evolve(self, table: str, columns: dict[str, str]) -> dict[str, str]:
        """Add and widen columns; returns the given ones in the table's types.

        Columns that another instance has added since are learnt by the next read: objects of different types unite.
        """
        if self._schemas_at is None:
            self._registry()
        own = self._learn(table, columns)
        return {c: own[c] for c in columns}

    # writing

    def write(self, body: str | bytes, precision: str = "ns") -> WriteResult:
        """Line protocol; durable when it returns. Bad lines are reported and the others written."""
        if precision not in PRECISION_NS:
            raise EngineError(400, f"precision is one of {', '.join(PRECISION_NS)}")
        if not body.strip():
            raise EngineError(400, "empty body")
        parsed = lineproto.parse_body(self.spark, body, precision)
        return self.write_points(parsed)

    def write_points(self, parsed: DataFrame, version: int | None = None, errors_key: str | None = None) -> WriteResult:
        """Upsert the points of a parsed frame; all its errors are returned, or with ``errors_key`` written.

        A batch keeps one row of each key, the last by ``ordinal``, and all its rows have the batch's version as
        their ``seq``: later batches have higher ones, whatever their size and whoever writes them. A given
        ``version`` fixes the objects' names too: a batch that is written again replaces itself.
        ``errors_key`` is for batches of any size: their errors (ordinal, line, error) become
        a table of that name in the store, and the result has its path and their number.
        """
        parsed = parsed.persist()
        try:
            version = self.manifest.next_version() if version is None else version
            points = parsed.where("error IS NULL")
            bad = parsed.where("error IS NOT NULL").select("ordinal", F.col("line_no").alias("line"), "error")
            errors, path = [], None
            if errors_key is None:
                errors = [{"line": r.line, "error": r.error} for r in bad.orderBy("ordinal").collect()]
                failed = len(errors)
            elif failed := bad.count():
                path = self.store.path(errors_key)
                bad.write.mode("overwrite").parquet(path)
            names: dict[str, list] = defaultdict(list)
            for r in names_and_types(points).collect():  # as many rows as there are columns
                names[r.measurement].append(r)
            total = 0
            for m in sorted(names):
                tags = sorted(r.name for r in names[m] if r.kind == "tag")
                fields = {r.name: lattice.TYPES[r["rank"]] for r in sorted(names[m], key=lambda r: r.name) if r.kind == "field"}
                total += self._write_measurement(m, points.where(F.col("measurement") == m), tags, fields, version)
            self.counters["written"] += total
            return WriteResult(points.count(), errors, failed, path)
        except PySparkException:
            self.counters["failed"] += 1
            raise
        finally:
            parsed.unpersist()

    def load(self, df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], time: str = "time", order: str | None = None) -> int:
        """Upsert a table's rows: the bulk path, without text in between. Returns the number of rows kept.

        Tags are read as text; a field has the narrowest type of the lattice that holds its column. Of equal
        keys the row with the largest ``order`` wins, or else any one. Rows without a time are an error.
        """
        kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double", "boolean": "boolean"}
        have = dict(df.dtypes)
        types = {c: "double" if have[c].startswith("decimal") else kinds.get(have[c], "string") for c in fields}
        table = identifier(measurement)
        t, f = self._columns_of(tags, fields)
        with self._locks[table]:
            wide = self._evolve(table, {c: "string" for c in t.values()} | {f[k]: types[k] for k in fields})
            rows = with_hash_of_columns(df, {k: k for k in tags}).select(
                F.col(time).cast("timestamp").alias("time"),
                "tag_hash",
                (F.lit(0) if order is None else F.col(order)).alias("seq"),
                *[F.col(k).cast("string").alias(c) for k, c in t.items()],
                *[lattice.widen(F.col(k).cast(types[k]), types[k], wide[c]).alias(c) for k, c in f.items()],
            )
            return self._upsert(table, rows, wide, self.manifest.next_version())

    @staticmethod
    def _columns_of(tags: Sequence[str], fields: Sequence[str]) -> tuple[dict[str, str], dict[str, str]]:
        try:
            return distinct_columns(list(tags), tag_column), distinct_columns(list(fields), field_column)
        except ValueError as e:
            raise EngineError(400, str(e)) from None

    def _write_measurement(self, measurement: str, points: DataFrame, tags: list[str], fields: dict[str, str], version: int) -> int:
        table = identifier(measurement)
        t, f = self._columns_of(tags, list(fields))
        with self._locks[table]:
            types = self._evolve(table, {c: "string" for c in t.values()} | {f[k]: fields[k] for k in fields})
            return self._upsert(table, wide_rows(points, tags, {k: types[f[k]] for k in fields}), types, version)

    def _upsert(self, table: str, rows: DataFrame, types: dict[str, str], version: int) -> int:
        """Write the newest row of each key to both tiers, by the batch's own order ``seq``, which the version replaces. Durable in the cold tier first."""
        with self._locks[table]:
            rows = newest_by_seq(rows).withColumn("seq", F.lit(version).cast("bigint")).persist()
            try:
                bounds = rows.agg(F.count("*").alias("n"), F.count("time").alias("timed"), F.min("time").alias("a"), F.max("time").alias("b")).first()
                if not bounds.n:
                    return 0
                if bounds.timed < bounds.n:
                    raise EngineError(400, "rows without a time")
                if self.config.write_through:  # cold first: it has every write that was acknowledged
                    key = staging_key(table, version, version)
                    rows.write.mode("overwrite").option("compression", "zstd").parquet(self.store.path(key))
                    self.manifest.commit([ObjectMeta(table, "staging", key, bounds.a.astimezone(UTC), bounds.b.astimezone(UTC), bounds.n, version, version, types)])
                hot = tiering.write_rows(self.store, rows, f"{table}/hot/{version:020d}", chunk=self._chunk, cols=types, measurement=table, kind="hot", rows_in=bounds.n)
                self.manifest.commit(hot)
                return bounds.n
            finally:
                rows.unpersist()

    # reading

    def relation(self, measurement: str, tier: str = "hot", start=None, end=None) -> DataFrame:
        """A table as a DataFrame. The window prunes cold objects, not rows, and never the hot tier."""
        if tier not in TIERS:
            raise EngineError(400, f"tier is one of {', '.join(TIERS)}")
        if tier != "hot" and not self.config.query_engine:
            raise EngineError(503, "the cold query engine is off")
        table = identifier(measurement)
        self._registry()
        objects = [] if tier == "cold" else self.manifest.objects(table, ["hot"])
        cold = [] if tier == "hot" else self.manifest.objects(table, COLD, as_utc(start), as_utc(end))
        for o in [*objects, *cold]:  # an object may be newer than the registry
            self._learn(table, o.columns)
        columns = self._ordered(self._schemas.get(table, {}))
        hot = None if tier == "cold" else federation.hot_relation(self.store, objects, columns)
        return hot if tier == "hot" else federation.federated_relation(hot, self.store, cold, columns)

    def query(self, sql: str, params: Sequence[object] = (), tier: str = "hot", start=None, end=None) -> DataFrame:
        """Spark SQL over the tables it names, each as a view of this request alone. ``$1`` parameters are for the hot tier."""
        if tier not in TIERS:
            raise EngineError(400, f"tier is one of {', '.join(TIERS)}")
        if params and tier != "hot":
            raise EngineError(400, "parameters are for the hot tier")
        session = self.spark.newSession()
        session.conf.set("spark.sql.session.timeZone", "UTC")
        try:
            text, args = sqlapi.prepare(sql, params, start, end, self.config.schema)
            if "time_bucket" in text.lower():
                register_time_bucket(session)
            for t in sqlapi.named_tables(text, self.tables()):
                # the relation belongs to the engine's session; its plan is handed to the request's
                self._view(session, t, self.relation(t, tier, start, end))
            return session.sql(text, args=args) if args else session.sql(text)
        except (PySparkException, ValueError) as e:
            raise EngineError(400, str(e)) from e

    @staticmethod
    def _view(session: SparkSession, name: str, df: DataFrame) -> None:
        plan = df._jdf.queryExecution().analyzed()
        session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan).createOrReplaceTempView(name)

    def query_pieces(self, sql: str, params: Sequence[object] = (), tier: str = "hot", start=None, end=None) -> Iterator[str]:
        """The answer as JSON, piece by piece; the first one is made at once, so that a request that can't be served fails here."""
        try:
            pieces = sqlapi.json_pieces(self.query(sql, params, tier, start, end))
            return chain([next(pieces)], pieces)
        except PySparkException as e:
            raise EngineError(400, str(e)) from e

    def query_json(self, sql: str, params: Sequence[object] = (), tier: str = "hot", start=None, end=None) -> str:
        return "".join(self.query_pieces(sql, params, tier, start, end))

    # changing

    def delete(self, measurement: str, tags: dict[str, str] | None = None, start=None, end=None) -> int:
        """Delete hot rows with these tags in [start, end); returns their number. Cold rows stay.

        Only chunks that lose rows are rewritten, to new folders; one commit swaps them.
        """
        table, columns = identifier(measurement), self.columns(measurement)
        filters = {tag_column(k): v for k, v in (tags or {}).items()}
        if any(c not in columns for c in filters):
            return 0
        doomed = F.lit(True)
        for c, v in filters.items():
            doomed &= F.col(c) == v
        a, b = as_utc(start), as_utc(end)
        if a is not None:
            doomed &= F.col("time") >= F.lit(a)
        if b is not None:
            doomed &= F.col("time") < F.lit(b)
        with self._locks[table]:
            chunks = self._chunks(table, a, b)
            if not chunks:
                return 0
            merged = federation.hot_relation(self.store, [o for some in chunks.values() for o in some], columns)
            micros = self._chunk // timedelta(microseconds=1)
            chunk = F.timestamp_micros(F.unix_micros("time") - F.pmod(F.unix_micros("time"), F.lit(micros)))
            hit = {r.c.astimezone(UTC): r.n for r in merged.where(doomed).groupBy(chunk.alias("c")).agg(F.count("*").alias("n")).collect()}  # a row per chunk at most
            old = [o for (start_, _), some in chunks.items() if start_ in hit for o in some]
            if old:
                self._replace(table, columns, old, federation.hot_relation(self.store, old, columns).where(~F.coalesce(doomed, F.lit(False))))
            return sum(hit.values())

    def _chunks(self, table: str, start: datetime | None = None, end: datetime | None = None) -> dict[tuple[datetime, datetime], list[ObjectMeta]]:
        """Hot objects by their chunk of time."""
        out: dict[tuple[datetime, datetime], list[ObjectMeta]] = defaultdict(list)
        for o in self.manifest.objects(table, ["hot"], start, end):
            out[tiering.chunk_of(o.range_start, self._chunk)].append(o)
        if start is None and end is None:
            return out
        # all objects of a chunk, also those outside the window
        return {k: [o for o in self.manifest.objects(table, ["hot"]) if tiering.chunk_of(o.range_start, self._chunk) == k] for k in out}

    def _replace(self, table: str, columns: dict[str, str], old: list[ObjectMeta], rows: DataFrame) -> None:
        """Put merged rows in place of objects. A merged row has written every column."""
        key = f"{table}/hot/fold-{self.manifest.next_version()}"
        new = tiering.write_rows(self.store, rows, key, sum(self.store.bytes_of(o.object_key) for o in old), self.config.compact_target_bytes, self._chunk, columns, table, "hot")
        self.manifest.commit(add=new, remove=old)
        for o in old:
            self.store.delete(o.object_key)

    def fold(self, measurement: str) -> int:
        """Merge the hot writes of each chunk that has several objects into one; returns how many chunks."""
        table = identifier(measurement)
        with self._locks[table]:
            several = [some for some in self._chunks(table).values() if len(some) > 1]
            if several:
                old = [o for some in several for o in some]
                self._replace(table, self.columns(table), old, federation.hot_relation(self.store, old, self.columns(table)))
            return len(several)

    # tiers

    def compact(self, measurement: str | None = None) -> list[dict]:
        """Merge staging objects into one folder per day, keeping the newest row of each key and its seq."""
        out = []
        for table in [identifier(measurement)] if measurement else self.tables():
            with self._locks[table]:
                staged = self.manifest.objects(table, ["staging"])
                if not staged:
                    continue
                columns = self.columns(table)
                rows = tiering.compacted(federation.scan(self.store, staged, columns))
                key = f"{table}/cold/{min(o.min_seq for o in staged):020d}-{max(o.max_seq for o in staged):020d}"
                new = tiering.write_rows(self.store, rows, key, sum(self.store.bytes_of(o.object_key) for o in staged), self.config.compact_target_bytes, timedelta(days=1), columns, table, "cold")
                self.manifest.commit(add=new, remove=staged)
                for o in staged:
                    self.store.delete(o.object_key)
                out += [{"measurement": table, "object": o.object_key, "rows": o.rows, "merged": len(staged)} for o in new]
        return out

    def evict(self, older_than: str | None = None, measurement: str | None = None, now: datetime | None = None) -> list[dict]:
        """Drop hot chunks that ended before the window. A chunk that cold doesn't cover is exported first."""
        limit = (as_utc(now) or datetime.now(UTC)) - timedelta(microseconds=parse_width(older_than or self.config.hot_window)[1])
        out = []
        for table in [identifier(measurement)] if measurement else self.tables():
            with self._locks[table]:
                columns = self.columns(table)
                cold = islands((o.range_start, o.range_end) for o in self.manifest.objects(table, COLD))
                old = {c: some for c, some in sorted(self._chunks(table).items()) if c[1] <= limit}
                bare = [c for c in old if not covers(cold, *c)]
                exported = self._export(table, columns, [o for c in bare for o in old[c]]) if bare else []
                gone = [o for some in old.values() for o in some]
                self.manifest.commit(add=exported, remove=gone)
                for o in gone:
                    self.store.delete(o.object_key)
                rows = {c: sum(o.rows for o in exported if c[0] <= o.range_start < c[1]) for c in old}
                out += [{"measurement": table, "chunk_start": a.isoformat(), "chunk_end": b.isoformat(), "exported": rows[a, b]} for a, b in old]
        return out

    def _export(self, table: str, columns: dict[str, str], objects: list[ObjectMeta]) -> list[ObjectMeta]:
        """Write the merged rows of some chunks to the cold tier, all in one job."""
        rows = federation.hot_relation(self.store, objects, columns)
        size = sum(self.store.bytes_of(o.object_key) for o in objects)
        return tiering.write_rows(self.store, rows, f"{table}/cold/export-{self.manifest.next_version()}", size, self.config.compact_target_bytes, min(self._chunk, timedelta(days=1)), columns, table, "export")

    def export_range(self, measurement: str, path: str, start, end) -> int:
        """Write hot rows of [start, end) as Parquet; returns their number without a second pass."""
        from pyspark.sql import Observation

        seen = Observation()
        rows = self.relation(measurement).where((F.col("time") >= F.lit(as_utc(start))) & (F.col("time") < F.lit(as_utc(end))))
        rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return seen.get["n"]

    def retain(self, older_than: str, measurement: str | None = None, now: datetime | None = None) -> int:
        """Drop hot chunks older than the window whether or not cold has them; returns how many."""
        limit = (as_utc(now) or datetime.now(UTC)) - timedelta(microseconds=parse_width(older_than)[1])
        n = 0
        for table in [identifier(measurement)] if measurement else self.tables():
            for (_, b), objects in self._chunks(table).items():
                if b <= limit:
                    self.manifest.commit(remove=objects)
                    for o in objects:
                        self.store.delete(o.object_key)
                    n += 1
        return n

    def show_chunks(self, measurement: str) -> list[dict]:
        """Hot chunks with their objects, rows and bytes."""
        return [{"chunk_start": a, "chunk_end": b, "objects": len(o), "rows": sum(x.rows for x in o), "bytes": sum(self.store.bytes_of(x.object_key) for x in o)} for (a, b), o in sorted(self._chunks(identifier(measurement)).items())]

    def tier_run(self, older_than: str | None = None, measurement: str | None = None, now: datetime | None = None) -> dict:
        if not self.config.query_engine:
            raise EngineError(503, "the cold query engine is off")
        done = {"compacted": self.compact(measurement), "evicted": self.evict(older_than, measurement, now)}
        self.manifest.fold(self.config.log_files)
        return done

    def tier_status(self) -> dict:
        rows = [r.asDict() for r in self.manifest.status().collect()]
        for r in rows:
            r |= {c: r[c].astimezone(UTC).isoformat() for c in ("range_start", "range_end")}
        return {"enabled": self.config.query_engine, "hot_window": self.config.hot_window, "objects": rows}

    def health(self) -> dict:
        return {"status": "ok", **self.counters}
