"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are placed in order of falling length, each into the open bin that it leaves the fullest. If
none has room, a bin of the permitted length with the least cost per unit that can still be used is
opened. Each shard is also packed with every single permitted length as the one opened, all bins are
downsized to their contents, and the plan of the least cost stays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
SHARD_PIECES = 20_000


def _cost(capacity: int, overhead: int) -> int:
    """Of one bin: its length, padding included, and a fixed part."""
    return capacity + overhead


def plan(sizes: np.ndarray, capacities: Sequence[int], opened: int | None, overhead: int) -> tuple[list[int], list[int]]:
    """The bin of each size (given in falling order) and the load of each bin; ``opened``: the length to open, None for the cheapest."""
    room: dict[int, list[int]] = {}  # bins by the room that is left
    mask = 0  # the rooms that occur, as bits
    bins, loads = [], []
    left = int(sizes.sum())
    for n in sizes.tolist():
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            fits = [c for c in capacities if c >= n]
            r = max(opened, fits[0]) if opened else min(fits, key=lambda c: (_cost(c, overhead) / min(c, left), c))
            b = len(loads)
            loads.append(0)
        bins.append(b)
        loads[b] += n
        left -= n
        if r > n:
            room.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    return bins, loads


def downsized(load: int, capacities: Sequence[int]) -> int:
    return next(c for c in capacities if c >= load)


def best_plan(sizes: np.ndarray, capacities: Sequence[int], overhead: int) -> tuple[list[int], list[int]]:
    plans = [plan(sizes, capacities, c, overhead) for c in (None, *capacities)]
    return min(plans, key=lambda p: sum(_cost(downsized(x, capacities), overhead) for x in p[1]))


def pack(docs: DataFrame, length_col: str, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_offset, bin_load, capacity``: a row per piece.

    A document longer than the largest capacity is cut into pieces of it and a rest; every unit of
    length (token, word) is in one piece. A null length counts as zero; a document of length zero has one
    row without a bin. Rows
    that share an id are packed each on its own. Ties between lengths go by id and piece. Shards of
    about ``shard_pieces`` pieces, dealt by hash, are packed alone, so the only loss against one global
    packing is the last bins of each shard.
    """
    capacities = sorted(set(map(int, capacities)))
    top = capacities[-1]
    n = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(n, F.lit(0)).alias("_n"))
    # lengths may be dear to make; and the written rows have places that deal null and repeated ids out evenly
    items = write_table(items, "pack-lengths").withColumn("_row", F.monotonically_increasing_id())
    some = items.where("_n > 0")
    pieces = some.agg(F.sum(F.ceil(F.col("_n") / F.lit(top)))).first()[0] or 0
    shards = max(1, math.ceil(int(pieces) / shard_pieces))
    cut = some.select("doc_id", "_n", "_row", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(top).cast("long"))).alias("piece", "start")).select(
        "doc_id", "_row", F.col("piece").cast("int").alias("piece"), "start", F.least(F.lit(top), F.col("_n") - F.col("start")).alias("length")
    )
    cut = cut.withColumn("_shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards))).drop("_row")
    columns = ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_load", "capacity"]
    schema = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, bin_load long, capacity long"

    def one(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = shard["length"].to_numpy()
        bins, loads = best_plan(sizes, capacities, overhead)
        filled, offsets = [0] * len(loads), []
        for b, s in zip(bins, sizes.tolist()):
            offsets.append(filled[b])
            filled[b] += s
        b = np.array(bins, np.int64)
        load = np.array(loads, np.int64)
        caps = np.array([downsized(x, capacities) for x in loads], np.int64)
        out = [shard["doc_id"], shard["piece"], shard["start"], shard["length"], pa.array(b + (shard["_shard"][0].as_py() << 32)), pa.array(offsets, pa.int64()), pa.array(load[b]), pa.array(caps[b])]
        return pa.table(out, columns)

    packed = cut.groupBy("_shard").applyInArrow(one, schema)
    blank = items.where("_n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), *(F.lit(None).cast("long").alias(c) for c in columns[4:]))
    return packed.unionByName(blank)
