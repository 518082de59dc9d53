"""Exact top-k search by inner product: tiled matrix products and a tree of merges.

Queries are dealt into blocks and candidates into shards of bounded size. Each (block, shard) tile is
one matrix product whose task keeps the k best of the shard for each query, and the lists of
neighbouring shards are merged in rounds, so that no task sees more than ``FAN_IN`` lists of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 2048
SHARD = 8192
FAN_IN = 16


def scaled(vector: Column, by: int) -> Column:
    """floor(by * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(by))))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where that is exact."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best_of_tile(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, candidate and score of each row's k best by (score desc, id asc), the row's own id left out."""
    least = np.iinfo(np.int64).min
    own = q_ids[:, None] == c_ids[None, :]
    if scores.shape[1] > k + 1:
        held = np.where(own, least, scores)
        bar = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        row, col = np.nonzero((scores >= bar[:, None]) & ~own)
    else:
        row, col = np.nonzero(~own)
    score, ids = scores[row, col], c_ids[col]
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    return row[kept], ids[kept], score[kept]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query, exactly.

    Vectors are arrays of whole numbers. A query is held against all candidates of its dimension but
    those of its own id; ties go to the smaller id; a query has fewer rows if there are fewer
    candidates. Rows whose id, vector or any component is null take no part. Of queries that share an
    id, the one with the smallest vector is used; of candidates that share an id each is one. No
    query or no candidate gives an empty result. Scores are 64-bit and wrap beyond that.
    """
    fit = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null)").withColumn("dim", F.size("v"))
    q = fit(queries).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("m")).select("id", "m.v", "m.dim")
    c = fit(candidates)
    n_q, n_c = q.count(), c.count()
    blocks, shards = max(1, math.ceil(n_q / BLOCK)), max(1, math.ceil(n_c / SHARD))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # repeated candidates share an id: dealt by vector too, they don't gather in one shard
    q = q.withColumn("block", deal(blocks, 1)).withColumn("shard", spread(shards))
    c = c.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", spread(blocks))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids, c_ids = left["id"].to_numpy(), right["id"].to_numpy()
        vectors = _matrix(right["v"], len(c_ids))
        rows: list[tuple] = []
        for at in range(0, len(q_ids), 256):
            some = left.slice(at, 256)
            row, ids, score = best_of_tile(_products(_matrix(some["v"], some.num_rows), vectors), q_ids[at : at + 256], c_ids, k)
            rows.append((q_ids[at : at + 256][row], ids, score))
        query, ids, score = (np.concatenate(x) for x in zip(*rows))
        return pa.table({"query_id": query, "shard": np.full(len(query), left["shard"][0].as_py(), np.int32), "vec_id": ids, "score": score})

    keys = ["block", "shard", "dim"]
    lists = q.groupBy(keys).cogroup(c.groupBy(keys)).applyInArrow(tile, "query_id long, shard int, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        lists = (
            lists.withColumn("shard", F.floor(F.col("shard") / F.lit(FAN_IN)).cast("int"))
            .withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order)))
            .where(F.col("_r") <= k)
            .drop("_r")
        )
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.select("query_id", ranked.alias("rank"), "vec_id", "score")


def brute_top_k(vectors: pd.DataFrame, query_ids: set[int], k: int) -> list[tuple]:
    """The same over (vec_id, vector) in memory, for tests."""
    out = []
    for qid, qv in zip(vectors.vec_id, vectors.vector):
        if qid in query_ids:
            found = sorted((-int(np.dot(qv, v)), i) for i, v in zip(vectors.vec_id, vectors.vector) if i != qid)[:k]
            out += [(qid, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out
