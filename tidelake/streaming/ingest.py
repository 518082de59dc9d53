"""Continuous ingest, and rollups of endless streams."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..functions.time import PRECISION_NS
from ..sources import lineproto

def _version(engine: Engine, checkpoint: str, batch_id: int) -> int:
    """The version of a batch, drawn when it is first tried and kept beside the checkpoint for when it is tried again."""
    jvm = engine.spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/_versions/{batch_id}")
    fs = path.getFileSystem(engine.spark._jsc.hadoopConfiguration())
    try:
        got = fs.open(path)
        try:
            return got.readLong()
        finally:
            got.close()
    except Py4JJavaError as e:  # none, or one that was not written to its end
        if not e.java_exception.getClass().getName().endswith(("FileNotFoundException", "EOFException")):
            raise
    version = engine.manifest.next_version()
    out = fs.create(path, True)
    out.writeLong(version)
    out.close()
    # an earlier batch has ended, and isn't tried again
    fs.delete(jvm.org.apache.hadoop.fs.Path(path.getParent(), str(batch_id - 1)), False)
    return version


def ingest(engine: Engine, lines: DataFrame, checkpoint: str, precision: str = "ns", every: str = "500 milliseconds", available_now: bool = False) -> StreamingQuery:
    """Write a stream of line-protocol text (column ``value``) to the engine.

    A micro-batch has a version, drawn from the clock as any other write's when it is first tried, and
    objects named after it: a batch that is run again after a failure replaces what it had written. Late
    points are upserts like any other, so there is no watermark. Bad lines are counted as failed and
    skipped; a batch's errors are the table ``_errors/N`` of the store, N being the batch's version.
    The source's rate options bound a batch, and its backlog waits in the source.
    """
    if precision not in PRECISION_NS:
        raise ValueError(f"precision is one of {', '.join(PRECISION_NS)}")

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.select(F.monotonically_increasing_id().alias("ordinal"), F.lit(None).cast("bigint").alias("line_no"), F.col("value").alias("line"))
        version = _version(engine, checkpoint, batch_id)
        done = engine.write_points(lineproto.parse_lines(numbered, precision), version, f"_errors/{version}")
        engine.counters["failed"] += done.failed

    stream = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime=every)).start()


def rollup_stream(rows: DataFrame, width: str, late: str, keys: Sequence[str], values: Mapping[str, str], time: str = "time") -> DataFrame:
    """Tumbling averages of a stream; a bucket is final ``late`` after its end, and state beyond that is dropped."""
    origin = "4 days" if width.split()[1].startswith("week") or width == "7 days" else None
    window = F.window(time, width, startTime=origin) if origin else F.window(time, width)
    out = rows.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*[F.avg(c).alias(n) for n, c in values.items()], F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *keys, *values, "n")


class Schedule:
    """Runs a job (compaction, eviction, a rollup's refresh) every so often until stopped; an error doesn't end it."""

    def __init__(self, job: Callable[[], object], seconds: float):
        self.job, self.seconds, self.errors = job, seconds, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def _loop(self) -> None:
        while not self._stop.wait(self.seconds):
            try:
                self.job()
            except Exception as e:  # the next turn may succeed
                self.errors.append(str(e))

    def start(self) -> Schedule:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
