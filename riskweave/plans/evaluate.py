"""The whole evaluation: transactions in, decisions out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.embed import hash_embedding
from riskweave.operators.activity import account_features
from riskweave.operators.redact import redact_transactions
from riskweave.operators.rules import rule_gate
from riskweave.operators.scoring import (
    Model, assess, decide_early, heuristic, history_risk, reads_neighbours, score,
)
from riskweave.operators.sparse import as_sparse, is_sparse
from riskweave.operators.vectors import embed_transactions, existing_only, knn, similarity_summary
from riskweave.session import cut

Embed = Callable[[Column], Column]


def gate(
    transactions: DataFrame, cfg: RiskConfig = RiskConfig(), busy: DataFrame | None = None
) -> DataFrame:
    """Phase one: features and gate columns on every transaction. One shuffle, on the account."""
    return rule_gate(account_features(transactions, cfg, busy), cfg)


def stored_vectors(transactions: DataFrame, embed: Embed = hash_embedding, embeddings: DataFrame | None = None) -> DataFrame:
    """`id, embedding, at_us` of known transactions, as they were stored or as `embed` makes them.

    Places and weights where the embedder has such a form.
    """
    at = transactions.select("id", F.unix_micros("occurred_at").alias("at_us"))
    if embeddings is not None:
        return few_places(embeddings.select("id", "embedding"), embed).join(at, "id")
    embed = getattr(embed, "sparse", embed)
    # The rows are dealt out while they are slim: few files would make few tasks of the search.
    tasks = int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = transactions.withColumn("at_us", F.unix_micros("occurred_at")).repartition(tasks, "id")
    return embed_transactions(rows, embed, keep=("at_us",))


def few_places(vectors: DataFrame, embed: Embed) -> DataFrame:
    """Stored vectors of an embedder, as places and weights if it has such a form."""
    return vectors.withColumn("embedding", as_sparse("embedding")) if hasattr(embed, "sparse") else vectors


def similar_to_flagged(
    flagged: DataFrame,
    vectors: DataFrame,
    cfg: RiskConfig = RiskConfig(),
    embed: Embed = hash_embedding,
    as_of: Sequence[str] = ("at_us",),
    self_takes_slot: bool = True,
) -> DataFrame:
    """`query_id, id, similarity, rank`: earlier transactions most similar to each flagged one.

    A flagged row is searched by its own text. Its vector was stored before
    it is searched, so it takes one of the places and is then left out; rows
    that came later, by `as_of` and then by id, are not there yet.
    """
    embed = embed.sparse if is_sparse(vectors) else embed
    queries = embed_transactions(flagged.withColumn("at_us", F.unix_micros("occurred_at")), embed, keep=as_of)
    return knn(queries, vectors, cfg.max_neighbours, cfg, self_takes_slot, as_of=as_of)


def neighbours(matches: DataFrame, transactions: DataFrame, model: Model = heuristic) -> DataFrame:
    """`id, similar_count, similar_mean` of the flagged rows that have known neighbours, and these if the model reads them."""
    known = existing_only(matches, transactions)
    if not reads_neighbours(model):
        return similarity_summary(known)
    told = redact_transactions(known.select("id").distinct().join(transactions, "id"))
    return similarity_summary(known.join(told, "id"), [c for c in told.columns if c != "id"])


def score_flagged(
    flagged: DataFrame,
    similar: DataFrame,
    cfg: RiskConfig = RiskConfig(),
    model: Model = heuristic,
    availability: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Phase two on flagged rows.

    `availability` marks parts that could not be computed, per row: without
    `neighbours_ok` the assessment runs as if there were none; without
    `assessment_ok` or `history_ok` the part is left out of the score.
    """
    available = {name: F.coalesce(ok, F.lit(False)) for name, ok in (availability or {}).items()}
    rows = flagged.join(similar, "id", "left")
    if "neighbours_ok" in available:
        rows = rows.withColumn("similar_count", F.when(available["neighbours_ok"], F.col("similar_count")))
    rows = history_risk(assess(rows, model))
    for name in ("assessment_ok", "history_ok"):
        if name in available:
            known = F.col(name) if name in rows.columns else F.lit(True)
            rows = rows.withColumn(name, known & available[name])
    return score(rows, cfg)


def evaluate(
    transactions: DataFrame,
    embeddings: DataFrame | None = None,
    cfg: RiskConfig = RiskConfig(),
    busy: DataFrame | None = None,
    model: Model = heuristic,
    self_takes_slot: bool = True,
    evaluated_at: Column | None = None,
    availability: Mapping[str, Column] | None = None,
    embed: Embed = hash_embedding,
) -> DataFrame:
    """Every transaction with `decision`, `risk_score`, `reasoning`, `evaluated_at`.

    Rows the gate approves or blocks are settled by it; only flagged rows take
    the costly part, and only they have its columns filled. `evaluated_at`
    defaults to the time of the transaction, so that a run can be repeated.
    `embeddings` are stored vectors of `embed`; by default it makes them.
    """
    # Phase one runs once: its rows are the source of all that follows.
    gated = cut(gate(transactions, cfg, busy))
    flagged = gated.filter(F.col("gate_decision") == V.DECISIONS[1])
    vectors = stored_vectors(transactions, embed, embeddings)
    matches = similar_to_flagged(flagged, vectors, cfg, embed, self_takes_slot=self_takes_slot)
    scored = score_flagged(flagged, neighbours(matches, transactions, model), cfg, model, availability)
    clock = F.col("occurred_at") if evaluated_at is None else evaluated_at
    return decide_early(gated).unionByName(scored, allowMissingColumns=True).withColumn("evaluated_at", clock)
