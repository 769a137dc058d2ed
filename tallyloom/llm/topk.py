"""Exact top-k by inner product without random access.

A shard of candidates keeps one sorted list per dimension. For a query the
lists are read from the end that helps it, a stretch at a time. What has been
read gives every candidate a lower and an upper bound of its score; candidates
whose upper bound is below the k-th lower bound leave, and reading stops when
no outsider can qualify. The scores of those left are then resolved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, parts

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
QUERIES_AT_ONCE = 256
#: Shares of a list after which the bounds are compared.
DEPTHS = (0.5, 0.7, 0.85, 0.95)
#: A query with at most so many candidates left has them resolved.
FEW = 64


def no_random_access(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """(candidate, query): who may still be among a query's k best when reading stops.

    ``own`` marks each query's own row. Positive weights read a dimension's list
    from the top, negative ones from the bottom. A component that has not been
    read lies between the value where reading stands and the end of the list.
    """
    n = len(x)
    lists = np.sort(x, axis=0)[::-1]
    weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).T
    slack = 1e-5 * (np.abs(q).sum(axis=1) * np.abs(x).max() + 1)  # covers rounding in single precision
    alive = ~own
    reading = np.flatnonzero(alive.sum(axis=0) > k)
    for depth in (max(1, int(n * d)) for d in DEPTHS):
        if not len(reading):
            break
        top, bottom = lists[depth - 1], lists[n - depth]
        w = weights[:, reading]
        upper = np.concatenate([np.maximum(x, top), np.minimum(x, bottom)], axis=1) @ w
        lower = np.concatenate([np.where(x >= top, x, lists[-1]), np.where(x <= bottom, x, lists[0])], axis=1) @ w
        lower[~alive[:, reading]] = -np.inf
        kth = np.partition(lower, n - k, axis=0)[n - k]
        alive[:, reading] &= upper >= kth - slack[reading]
        reading = reading[alive[:, reading].sum(axis=0) > max(k, FEW)]
    return alive


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) * q.astype(np.int64)).sum(axis=1)


def as_integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(key, x): floor(scale * component) as longs; only finite vectors with an id.

    Of rows that share an id, the one with the least vector takes part.
    """
    v = F.transform(F.col("v"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("key"), F.col(vec_col).alias("v")).filter("key is not null and v is not null")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.filter(finite).select("key", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))
    return rows.groupBy("key").agg(F.min("x").alias("x"))


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
) -> DataFrame:
    """The k candidates of largest integer inner product for each query.

    Components become floor(scale * component). A query never meets a candidate
    with its own id. Ties go to the smaller id; with fewer than k candidates all
    are returned. Vectors that are NULL or hold NULL or non-finite components,
    and rows without an id, take no part; of rows that share an id, the least
    vector counts; vectors of another length than the query's are no candidates.
    Scores have to fit a long.

    Queries meet candidates in blocks: every (query block, candidate shard) is
    one group. Returns (query_id, rank, vec_id, score).
    """
    rows, asked = as_integers(vectors, id_col, vec_col, scale), as_integers(queries, id_col, vec_col, scale)
    n_shards, n_blocks = parts(vectors.count(), SHARD_ROWS), parts(queries.count(), QUERY_BLOCK)
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    shards = rows.withColumn("shard", bucket(n_shards, "key")).select("*", copies(n_blocks, "block"))
    blocks = asked.withColumn("block", bucket(n_blocks, "key")).select("*", copies(n_shards, "shard"))

    def one_group(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, same in c.groupby(c["x"].map(len)) if len(c) and len(q) else ():
            mine = q[q["x"].map(len) == width]
            if width == 0 or mine.empty:
                continue
            whole, ids = np.array(same["x"].tolist(), np.int64), same["key"].to_numpy()
            for lo in range(0, len(mine), QUERIES_AT_ONCE):
                part = mine.iloc[lo : lo + QUERIES_AT_ONCE]
                w, keys = np.array(part["x"].tolist(), np.int64), part["key"].to_numpy()
                alive = no_random_access(w.astype(np.float32), whole.astype(np.float32), ids[:, None] == keys, k)
                for i, key in enumerate(keys.tolist()):
                    left = np.flatnonzero(alive[:, i])
                    score = _exact_scores(w[i], whole[left])
                    best = np.lexsort((ids[left], -score))[:k]
                    found.append(pd.DataFrame({"query_id": key, "vec_id": ids[left][best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = shards.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(
        one_group, "query_id long, vec_id long, score long"
    )
    return best_of_shards(found, k, "score")


def best_of_shards(found: DataFrame, k: int, score: str) -> DataFrame:
    """The k best of what the shards found for each query, at most k rows a shard."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
