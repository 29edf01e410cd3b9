"""Exact top-k by inner product with no-random-access aggregation.

Candidates are cut into blocks; in a block every dimension is a list sorted by value, which a
query with a positive weight reads from the top and one with a negative weight from the bottom.
After some depth a candidate's score lies between what was read plus the worst and plus the best
that the unread places can hold. Candidates whose upper bound stays below the k-th best lower
bound are out. Reading stops when few others are left, and only these get final scores.
In some dozens of dimensions of either sign bounds tell nothing before most of a list is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per block of candidates and of queries, and the depths (shares of a list) at which bounds are compared.
CANDIDATES, QUERIES = 4096, 1024
DEPTHS = (0.25, 0.75, 0.9, 0.97)
# Reading stops when so many times k candidates a query are left.
FEW = 4


def floored(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while they stay below 2^53, else in longs."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def survivors(values: np.ndarray, weights: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Which candidates (columns) may be among each query's k best, `own` (not candidates) apart.

    A list is read twice: from the top for positive weights, from the bottom for negative ones.
    """
    n, alive = len(values), ~own
    order = np.argsort(values, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(values, order, axis=0)
    signed = np.hstack([np.maximum(weights, 0), np.minimum(weights, 0)])
    lists, place = np.hstack([values, values]), np.hstack([n - 1 - rank, rank])
    worst = np.hstack([ordered[0], ordered[-1]])
    for share in DEPTHS:
        depth = int(n * share)
        if depth < 1 or n <= FEW * k:
            continue
        read = place < depth
        so_far = _dot(signed, np.where(read, lists, 0))
        last = np.hstack([ordered[n - depth], ordered[depth - 1]])
        upper = so_far + _dot(signed * last, ~read)
        lower = np.where(own, -np.inf, so_far + _dot(signed * worst, ~read))
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        alive &= upper >= kth[:, None]
        if alive.sum() <= FEW * k * len(weights):
            break
    return alive


def block_top(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, weights: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best of a block (all, if fewer): score downwards, then id upwards."""
    alive = survivors(values, weights, query_ids[:, None] == ids[None, :], k)
    out = []
    for q in range(len(query_ids)):
        left = np.flatnonzero(alive[q])
        scores = _dot(weights[q : q + 1], values[left])[0]
        if len(left) > 8 * k:
            border = np.partition(scores, len(left) - k)[len(left) - k]
            keep = scores >= border
            left, scores = left[keep], scores[keep]
        best = np.lexsort((ids[left], -scores))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[left[best]], scores[best].astype(np.int64)))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors.

    `embedding` holds whole numbers. Rows with a null id or vector, or null components, take no
    part; rows that repeat an id count once (the smallest vector). Vectors meet vectors of their
    own length. Every block of queries meets every block of candidates, as a search must; both
    blocks are of bounded size, and k rows a query and block are shuffled afterwards.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("x"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x")))
    rows = rows.groupBy("id").agg(F.min("x").alias("x"), F.max("q").alias("q"))
    rows = rows.withColumn("dim", F.size("x"))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    blocks, query_blocks = -(-max(counts["n"], 1) // CANDIDATES), -(-max(counts["q"], 1) // QUERIES)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("dim", own(blocks).alias("block"), every(query_blocks).alias("part"), "id", "x")
    queries = rows.where("q").select("dim", own(query_blocks).alias("part"), every(blocks).alias("block"), "id", "x")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})
        return block_top(
            right["id"].to_numpy(np.int64), np.stack(right["x"].to_list()).astype(np.int64),
            left["id"].to_numpy(np.int64), np.stack(left["x"].to_list()).astype(np.int64), k,
        )

    keys = ["dim", "part", "block"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
