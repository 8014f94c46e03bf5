"""Embeddings and exact nearest neighbours.

Similarity is `(1 + cosine) / 2`, computed in double precision and rounded to
nine places; equal similarities rank by id, so results do not depend on how
the vectors were distributed.

Dense vectors are searched by cells around pivots (`cells`), those of few
places through inverted lists (`sparse`). Neither passes queries through the
driver; both return a bounded number of matches per query and unit of work,
which are merged by a rank limit that also runs before the shuffle.

Pairs exist only inside a unit's arithmetic; only the best become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.embed import hash_embedding
from riskweave.functions.text import transaction_text
from riskweave.operators import cells, sparse


def embed_transactions(
    transactions: DataFrame,
    embed: Callable[[Column], Column] = hash_embedding,
    keep: Sequence[str] = (),
) -> DataFrame:
    """`id, embedding, text` and the `keep` columns of every transaction.

    `embed` maps text to a vector and may be a model behind an Arrow UDF.
    """
    text = transactions.select("id", *keep, transaction_text().alias("text"))
    return text.select("id", embed(F.col("text")).alias("embedding"), "text", *keep)


def knn(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    cfg: RiskConfig = RiskConfig(),
    self_takes_slot: bool = False,
    min_similarity: float | None = None,
    as_of: Sequence[str] = (),
) -> DataFrame:
    """`query_id, id, similarity, rank`: the k most similar candidates of every query.

    Both inputs have `id, embedding`, dense or (`sparse.SPARSE`) as places and
    weights; sparse ones are found through inverted lists. A query never matches its own id; with
    `self_takes_slot` its own vector still uses up one of the k places.
    `min_similarity` is exclusive. Candidate ids may repeat if all copies
    have the same vector: they count once. `as_of` names columns of whole
    numbers in both inputs: only candidates that do not come after the query,
    by these and then by id, can match.
    """
    keep = k if self_takes_slot else k + 1
    columns = ["id", "embedding", *[F.col(c).cast("bigint").alias(c) for c in as_of]]
    queries, candidates = queries.select(*columns), candidates.select(*columns)
    if sparse.is_sparse(candidates):
        matches = sparse.matches(queries, candidates, keep, min_similarity)
    else:
        matches = cells.matches(queries, candidates, keep, min_similarity, cfg.cut_vectors)
    # Copies of a candidate are neighbours in this order and share a dense rank.
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    others = F.col("query_id") != F.col("id")
    ranked = (matches if self_takes_slot else matches.filter(others)).withColumn("rank", F.dense_rank().over(order))
    first = F.lag("id").over(order).eqNullSafe(F.col("id"))
    return (
        ranked.filter(F.col("rank") <= k)
        .withColumn("_again", first).filter(others & ~F.col("_again")).drop("_again")
    )


def similar_within(
    queries: DataFrame,
    candidates: DataFrame,
    radius: float = V.RADIUS,
    limit: int = V.RADIUS_LIMIT,
    cfg: RiskConfig = RiskConfig(),
) -> DataFrame:
    """The nearest candidates whose distance `1 - cosine` is below the radius."""
    near = knn(queries, candidates, limit, cfg, min_similarity=1.0 - radius / 2.0)
    return near.withColumn("distance", F.round(2.0 * (1.0 - F.col("similarity")), 8))


def existing_only(matches: DataFrame, transactions: DataFrame) -> DataFrame:
    """Matches whose transaction is known; ranks keep their gaps."""
    return matches.join(transactions.select("id"), "id", "left_semi")


def similarity_summary(matches: DataFrame, details: Sequence[str] = ()) -> DataFrame:
    """`id, similar_count, similar_mean` per query; the sum is exact in nine places.

    With `details`, also `similar`: the matches in order of rank, with their
    similarity and those columns.
    """
    listed = F.sort_array(F.collect_list(F.struct("rank", "id", "similarity", *details)))
    return matches.groupBy(F.col("query_id").alias("_query")).agg(
        F.count("*").alias("similar_count"),
        (F.sum(F.col("similarity").cast("decimal(12,9)")).cast("double") / F.count("*")).alias("similar_mean"),
        *([listed.alias("similar")] if details else []),
    ).withColumnRenamed("_query", "id")


def similarity_faults(matches: DataFrame) -> DataFrame:
    """Matches outside 0..1; there must be none."""
    return matches.filter(~F.coalesce(F.col("similarity").between(0.0, 1.0), F.lit(False)))
