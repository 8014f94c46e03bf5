"""Exact top-k by inner product over sorted lists that are only read in order.

Every block of candidates keeps one list per vector component, sorted by that
component. A query reads the lists from the end that suits the sign of its
weight, all to one depth, and knows for every candidate what it has read of
it. What it has not read lies between the list's front and its far end, which
gives each score a lower and an upper bound. Candidates whose upper bound is
below the k-th lower bound are outsiders. Reading goes on to twice the depth
until only k candidates are left or the lists are read; then the scores of
those left are resolved exactly.

Candidates and queries are dealt in blocks of bounded size: a task holds one
block of each. A block's best k go on to a ranking per query.

Rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part. Vectors are compared with vectors of the same length.
A row never answers a query of its own id; of rows that share an id each
counts. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Integers up to this size are exact in a double.
EXACT = 2.0**53


def bounds_at(x: np.ndarray, ranks: np.ndarray, ordered: np.ndarray, depth: int, q: np.ndarray):
    """Lower and upper bound of every score after reading all lists to a depth."""
    n = len(x)
    high, low = np.maximum(q, 0), np.minimum(q, 0)
    from_top, from_bottom = ranks >= n - depth, ranks < depth
    read = np.hstack([np.where(from_top, x, 0), np.where(from_bottom, x, 0), ~from_top, ~from_bottom])
    front_top, front_bottom = ordered[n - depth], ordered[depth - 1]
    upper = read @ np.hstack([high, low, high * front_top, low * front_bottom]).T
    lower = read @ np.hstack([high, low, high * ordered[0], low * ordered[-1]]).T
    return lower, upper


def read_lists(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """Best k of one block of candidates for each query of one block."""
    n = len(x)
    own = ids[:, None] == query_ids[None, :]
    open_to = ~own
    order = np.argsort(x, axis=0, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(x, order, axis=0)
    active, depth = np.arange(len(q)), max(1, n // 4)
    wide = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] >= EXACT
    while depth < n and n > k and len(active) and not wide:
        lower, upper = bounds_at(x, ranks, ordered, depth, q[active])
        mine = open_to[:, active]
        kth = np.partition(np.where(mine, lower, -np.inf), n - k, axis=0)[n - k]
        left = mine & (upper >= kth)
        open_to[:, active] = left
        active = active[left.sum(axis=0) > k]
        depth *= 2
    if wide:
        scores = x.astype(np.int64) @ q.astype(np.int64).T
    else:
        scores = np.rint(x @ q.T).astype(np.int64)
    for j, query in enumerate(query_ids):
        rows = np.flatnonzero(open_to[:, j])
        if len(rows) > k:
            cut = np.partition(scores[rows, j], len(rows) - k)[len(rows) - k]
            rows = rows[scores[rows, j] >= cut]
        best = rows[np.lexsort((ids[rows], -scores[rows, j]))][:k]
        for row in best:
            yield query, ids[row], scores[row, j]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096, query_rows: int = 1024,
    scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """Exact k best candidates of every query by the inner product of floor(scale * component)."""

    def clean(df: DataFrame) -> DataFrame:
        values = df.select(F.col(id_column).cast("bigint").alias("id"),
                           F.col(vector_column).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
        ints = F.transform("v", lambda c: F.floor(c * scale).cast("double"))
        return values.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).select(
            "id", F.size("v").alias("d"), ints.alias("v"))

    rows, asked = clean(vectors), clean(queries)
    blocks = max(1, -(-rows.count() // block_rows))
    parts = max(1, -(-asked.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = rows.select("*", deal(blocks, 1).alias("block"), every(parts).alias("part"))
    right = asked.select("*", deal(parts, 2).alias("part"), every(blocks).alias("block"))

    def answer(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = list(read_lists(mine["id"].to_numpy(), np.stack(mine["v"].to_numpy()),
                                theirs["id"].to_numpy(), np.stack(theirs["v"].to_numpy()), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ("d", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        answer, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
