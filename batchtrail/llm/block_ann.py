"""Nearest neighbours by a block matrix join with int8 tiles and exact recomputation.

Vectors are rounded to int8 with one scale each, and the length of the rounding
error is kept.  A tile multiplies a block of queries with a block of candidates
in int8 values (products and sums stay below 2^24, so single precision holds
them exactly), which bounds each distance from both sides:
``|x - y|`` differs from the distance of the rounded vectors by at most the sum
of the two error lengths.  An id's upper bound is the smallest of its vectors'.
A pair whose lower bound exceeds the query's k-th smallest upper bound of an id
cannot be among the k nearest; the others are recomputed in double precision and
each tile passes k ids per query id to the merge.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAREST = 10
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096


def quantized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, error length) of the rows of ``x``; ``values * scale`` is within the error of ``x``."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.where(scale > 0, scale, 1.0)  # also for values so small that the scale underflows
    values = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((x - values * scale[:, None]) ** 2).sum(axis=1))
    return values, scale, error


def tile_bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between two quantized blocks."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    dot = (qa.astype(exact) @ qb.astype(exact).T).astype(np.float64)
    la = (qa.astype(np.float64) ** 2).sum(axis=1) * sa ** 2
    lb = (qb.astype(np.float64) ** 2).sum(axis=1) * sb ** 2
    square = la[:, None] + lb[None, :] - 2 * dot * (sa[:, None] * sb[None, :])
    # rounding of the three terms, far below the quantisation error
    slack = 1e-12 * (la[:, None] + lb[None, :])
    off = ea[:, None] + eb[None, :]
    lower = np.sqrt(np.maximum(square - slack, 0)) * (1 - 1e-12) - off
    upper = np.sqrt(np.maximum(square, 0) + slack) * (1 + 1e-12) + off
    return lower, upper


def exact_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs in double precision, summed in component order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - y[:, j]) ** 2
    return np.sqrt(total)


def nearest_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, candidate id, distance), the ``k`` nearest candidate ids of each query id in this tile, itself excluded.

    The distance of two ids is the smallest of their vectors'.
    """
    order = np.argsort(cid, kind="stable")  # vectors of an id side by side
    cid, c = cid[order], c[order]
    lower, upper = tile_bounds(quantized(q), quantized(c))
    own = qid[:, None] == cid[None, :]
    upper[own] = np.inf
    first = np.flatnonzero(np.concatenate(([True], cid[1:] != cid[:-1])))
    near = ~own
    if len(first) > k:
        by_id = upper if len(first) == len(cid) else np.minimum.reduceat(upper, first, axis=1)
        near &= lower <= np.partition(by_id, k - 1, axis=1)[:, k - 1][:, None]
    row, col = np.nonzero(near)
    dist = np.concatenate([exact_distance(q[row[i:i + 65536]], c[col[i:i + 65536]]) for i in range(0, len(row), 65536)]
                          or [np.zeros(0)])
    query, found = qid[row], cid[col]
    order = np.lexsort((dist, found, query))
    query, found, dist = query[order], found[order], dist[order]
    once = np.ones(len(query), dtype=bool)  # each id once per query id, at its smallest distance
    once[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
    query, found, dist = query[once], found[once], dist[once]
    order = np.lexsort((found, dist, query))
    query, found, dist = query[order], found[order], dist[order]
    best = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[best], found[best], dist[best]


def usable(vector: Column) -> Column:
    """Whether a vector is not null or empty, has only finite components and is not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST,
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest other vectors of every query, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without an id.  Vectors of different length have
    no distance.  Rows repeated in id and vector count once; an id with several
    vectors takes part with each, as a query keeping its nearest over all of
    them, and as a neighbour once, at its smallest distance.  Empty input gives
    no rows.
    """
    base = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("is_query"))
            .where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"]))
    n, queries = base.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    parts, chunks = max(1, -(-n // candidate_block)), max(1, -(-(queries or 0) // query_block))
    salted = base.withColumn("dim", F.size("v"))
    # the grid: every candidate block meets every query block; the vectors of an id are spread over the blocks
    right = (salted.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    left = (salted.where("is_query").withColumn("chunk", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(chunks)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    left = left.select(*[F.col(c).cast("long").alias(f"q_{c}") for c in ("dim", "part", "chunk", "id")], F.col("v").alias("q_v"))
    right = right.select(*[F.col(c).cast("long").alias(f"c_{c}") for c in ("dim", "part", "chunk", "id")], F.col("v").alias("c_v"))

    def tile(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = nearest_in_tile(q["q_id"].to_numpy(), np.vstack(q["q_v"].to_numpy()), c["c_id"].to_numpy(),
                                np.vstack(c["c_v"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    tiles = (left.groupBy("q_dim", "q_part", "q_chunk").cogroup(right.groupBy("c_dim", "c_part", "c_chunk"))
             .applyInPandas(tile, "query_id long, vec_id long, score double"))

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, float] = {}
        for vec_id, score in zip(rows["vec_id"], rows["score"]):
            if score < best.get(vec_id, np.inf):
                best[vec_id] = score
        top = heapq.nsmallest(k, ((score, vec_id) for vec_id, score in best.items()))
        return pd.DataFrame({"query_id": key[0], "rank": range(1, len(top) + 1), "vec_id": [v for _, v in top],
                             "score": [s for s, _ in top]})

    return tiles.groupBy("query_id").applyInPandas(merged, "query_id long, rank int, vec_id long, score double")
