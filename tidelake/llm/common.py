"""Shared pieces of the corpus operators: scratch tables, words, fingerprints.

Words are maximal runs of bytes other than space and 0x09-0x0D, unchanged. Null texts hold none.
"""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder as scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
BROADCAST_BYTES = 8 << 20
TRIM_BYTES = 8 << 20
#: Spark deletes the shuffle files of a query when it has ended, instead of whenever the driver collects garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: list[DataFrame] = []
_open = threading.local()
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not on glibc
    _libc = None


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back. It survives lost executors.

    The shuffle files behind the table go when it has been written. ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidelake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    scopes = getattr(_open, "scopes", [])
    (scopes[-1] if scopes else _kept).append(out)
    return out


def release() -> None:
    """Delete the tables that results of the operators are still read from: for when all these have been written."""
    while _kept:
        drop_table(_kept.pop())


def drop_table(table: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written within it at its end, but for those that the yielded function is given.

    What outlives it must be read from kept tables alone. Nested scopes hand what they keep to the outer one.
    """
    _open.scopes = [*getattr(_open, "scopes", []), []]
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        own = _open.scopes.pop()
        for table in own:
            if not any(table is k for k in kept):
                drop_table(table)
        (_open.scopes[-1] if _open.scopes else _kept).extend(t for t in own if any(t is k for k in kept))


def checked_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table of ``write_table``, to be broadcast if its files hold ``limit`` bytes at most; beyond that joins shuffle."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if size <= limit else table


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or 16 MB, so that a Python worker's memory doesn't hang on row width."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def _trim() -> None:
    """Give freed memory back to the system: workers live through many stages, side by side with the JVM."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``limit`` bytes (always one row at least), with the place of their first row."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = freed = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to
        freed += int(ends[to - 1]) - before
        if freed > TRIM_BYTES:
            freed = 0
            _trim()


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than there are rows) into the flat array of the texts' words."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if full.all():
        return offsets, flat
    kept = np.concatenate([[0], np.cumsum(full)])
    return kept[offsets], flat.filter(pa.array(full))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w.as_buffer()) for w in coded.dictionary.cast(pa.binary())), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)[:n]


_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the n hashes from each place on; len(hashes) - n + 1 of them. Order counts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64)])
        return mix64((total[n:] - total[:-n]) * _powers(_INVERSE, len(hashes) - n + 1))
