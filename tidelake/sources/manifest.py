"""Objects of the store and the log that says which are live.

An object is a folder of Parquet files. The log is append-only: an entry adds or removes an object, the
newest entry of an object counts, and entries written together take effect together. Everything goes
through Hadoop's file systems, so a root on ``file:``, ``s3a:`` or any other scheme works alike.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import as_utc

SCHEMA = "measurement string, kind string, object_key string, range_start timestamp, range_end timestamp, rows bigint, min_seq bigint, max_seq bigint, created_at timestamp, columns string, live boolean, version bigint"
#: of rows with one seq the higher rank is used
RANK = {"staging": 0, "cold": 1, "export": 2, "hot": 3}


@dataclass
class ObjectMeta:
    measurement: str
    kind: str
    object_key: str
    range_start: datetime
    range_end: datetime
    rows: int
    min_seq: int
    max_seq: int
    columns: dict[str, str] = field(default_factory=dict)
    created_at: datetime | None = None


def staging_key(table: str, min_seq: int, max_seq: int) -> str:
    return f"{table}/staging/{min_seq:020d}-{max_seq:020d}"


class Store:
    """A root folder, reached by Hadoop's file system of its scheme."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def file_system(self, key: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(key))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, key: str) -> bool:
        fs, p = self.file_system(key)
        return fs.exists(p)

    def delete(self, key: str) -> None:
        """A missing object is no error."""
        fs, p = self.file_system(key)
        fs.delete(p, True)

    def bytes_of(self, key: str) -> int:
        fs, p = self.file_system(key)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def configure_s3(self, endpoint: str, access_key: str, secret_key: str, path_style: bool = True, ssl: bool = True) -> None:
        """Credentials for s3a roots; the connector's jars come with the cluster."""
        conf = self.spark._jsc.hadoopConfiguration()
        for k, v in {"endpoint": endpoint, "access.key": access_key, "secret.key": secret_key, "path.style.access": str(path_style).lower(), "connection.ssl.enabled": str(ssl).lower()}.items():
            conf.set(f"fs.s3a.{k}", v)


class Manifest:
    """The log of a store."""

    LOG = "_manifest"

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self._lock, self._last = threading.Lock(), 0

    def next_version(self) -> int:
        with self._lock:
            self._last = max(time.time_ns(), self._last + 1)
            return self._last

    def commit(self, add: Iterable[ObjectMeta] = (), remove: Iterable[ObjectMeta] = ()) -> None:
        """One small file with all entries: they appear together or not at all."""
        version, now = self.next_version(), datetime.now(UTC)
        rows = [(asdict(o) | {"created_at": o.created_at or now, "columns": json.dumps(o.columns), "live": live, "version": version}) for live, some in ((False, remove), (True, add)) for o in some]
        # an object that one commit removes and adds is added
        rows = list({r["object_key"]: r for r in rows}.values())
        if rows:
            order = [f.split()[0] for f in SCHEMA.split(", ")]
            self.spark.createDataFrame([tuple(r[c] for c in order) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.store.path(self.LOG))

    def mark(self) -> object:
        """Differs whenever the log does: the names of its files."""
        fs, p = self.store.file_system(self.LOG)
        return tuple(sorted(f.getPath().getName() for f in fs.listStatus(p))) if fs.exists(p) else ()

    def fold(self, least: int = 2) -> int:
        """Rewrite the log as one file with the newest entry of each object, if it has ``least`` files; returns how many went.

        Entries that remove an object stay, so that a reader who still finds an older file isn't misled: the
        new file is written before the files that it replaces go. For one maintainer at a time.
        """
        fs, p = self.store.file_system(self.LOG)
        old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")] if fs.exists(p) else []
        if len(old) < least:
            return 0
        log = self.spark.read.schema(SCHEMA).parquet(*[f.toString() for f in old])
        columns = [f.split()[0] for f in SCHEMA.split(", ")]
        newest = log.groupBy("object_key").agg(F.max_by(F.struct(*columns), "version").alias("m")).select("m.*")
        newest.coalesce(1).write.mode("append").parquet(self.store.path(self.LOG))
        for f in old:
            fs.delete(f, False)
        return len(old)

    def live(self) -> DataFrame:
        """All live objects."""
        if not self.store.exists(self.LOG):
            return self.spark.createDataFrame([], SCHEMA).drop("live", "version")
        log = self.spark.read.schema(SCHEMA).parquet(self.store.path(self.LOG))
        newest = log.groupBy("object_key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "object_key"]), "version").alias("m"))
        return newest.select("object_key", "m.*").where("live").drop("live", "version").select(*[f.split()[0] for f in SCHEMA.split(", ")][:-2])

    def objects(self, measurement: str | None = None, kinds: Iterable[str] | None = None, start: datetime | None = None, end: datetime | None = None) -> list[ObjectMeta]:
        """Live objects that the window meets (ends included), by start and sequence."""
        df = self.live()
        if measurement is not None:
            df = df.where(F.col("measurement") == measurement)
        if kinds is not None:
            df = df.where(F.col("kind").isin(list(kinds)))
        df = prune(df, start, end)
        out = []
        for r in df.orderBy("range_start", "min_seq", "object_key").collect():
            d = r.asDict()
            # collected timestamps are in the driver's local zone
            d |= {c: d[c].astimezone(UTC) for c in ("range_start", "range_end", "created_at")}
            out.append(ObjectMeta(**(d | {"columns": json.loads(d["columns"])})))
        return out

    def measurements(self) -> list[str]:
        return [r[0] for r in self.live().select("measurement").distinct().orderBy("measurement").collect()]

    def status(self) -> DataFrame:
        return object_status(self.live().where("kind <> 'hot'"))


def prune(objects: DataFrame, start: datetime | str | None, end: datetime | str | None) -> DataFrame:
    """Rows (range_start, range_end) that meet the closed window."""
    if start is not None:
        objects = objects.where(F.col("range_end") >= F.lit(as_utc(start)))
    if end is not None:
        objects = objects.where(F.col("range_start") <= F.lit(as_utc(end)))
    return objects


def object_status(objects: DataFrame) -> DataFrame:
    """Objects, rows and time range by measurement and kind."""
    return objects.groupBy("measurement", "kind").agg(F.count("*").alias("objects"), F.sum("rows").alias("rows"), F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).orderBy("measurement", "kind")
