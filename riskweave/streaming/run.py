"""The event loop as Structured Streaming queries.

Three queries share one event stream and one store:

* `start_evaluation`: received events -> saved, embedded, evaluated, published;
* `start_side_outputs`: rejected events and recorded decisions;
* `relay_outbox`: outbox rows -> stream records.

A bad event ends up in the reject table and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.embed import hash_embedding
from riskweave.operators.outbox import audit_log, route_outbox, to_outbox
from riskweave.operators.rules import rule_gate
from riskweave.operators.scoring import Model, decide_early, heuristic, reads_neighbours
from riskweave.operators.tables import upsert_latest
from riskweave.operators.validate import rejected_rows, valid_rows, validate_events
from riskweave.operators.vectors import embed_transactions
from riskweave.plans.evaluate import few_places, neighbours, score_flagged, similar_to_flagged
from riskweave.schemas import (
    ACCOUNT_FEATURES, DECIDED, REJECTS, STORED_EMBEDDINGS, TRANSACTION_COLUMNS,
)
from riskweave.session import cut, releasing
from riskweave.streaming.account_state import complete_features, data_batches_only, stream_velocity
from riskweave.streaming.store import read_all, read_batch, save_batch, write_batch

FLAG = V.DECISIONS[1]


def evaluate_batch(
    rows: DataFrame,
    batch_id: int,
    root: str,
    cfg: RiskConfig = RiskConfig(),
    embed: Callable[[Column], Column] = hash_embedding,
    model: Model = heuristic,
    clock: Column | None = None,
) -> None:
    """Save, embed, evaluate and publish the transactions of one micro-batch.

    `rows` comes from `stream_velocity`. Neighbours come from every vector
    stored so far, of this batch those of rows that are not later in event
    time; a transaction that came twice counts once.
    """
    with releasing():
        _evaluate_batch(rows, batch_id, root, cfg, embed, model, clock)


def _evaluate_batch(rows, batch_id, root, cfg, embed, model, clock) -> None:
    spark = rows.sparkSession
    # Written and read back: the table is what later steps start from.
    standing, reopened = save_batch(spark, cut(rows), root, batch_id)
    rows = read_batch(spark, root, "transactions", ACCOUNT_FEATURES, batch_id)
    if rows is None:
        return
    write_batch(embed_transactions(rows, embed, keep=("occurred_at",)), root, "embeddings", batch_id)
    gated = cut(rule_gate(complete_features(rows, standing, cfg, reopened), cfg))
    flagged = gated.filter(F.col("gate_decision") == FLAG)
    vectors = read_all(spark, root, "embeddings", STORED_EMBEDDINGS).withColumn("at_us", F.unix_micros("occurred_at"))
    asked = flagged.withColumn("batch_id", F.lit(batch_id))
    matches = similar_to_flagged(asked, few_places(vectors, embed), cfg, embed, as_of=("batch_id", "at_us"))
    known = upsert_latest(standing()) if reads_neighbours(model) else standing()
    scored = score_flagged(flagged, neighbours(matches, known, model), cfg, model)
    decided = (
        decide_early(gated).unionByName(scored, allowMissingColumns=True)
        .withColumn("evaluated_at", F.col("occurred_at") if clock is None else clock)
    )
    write_batch(decided.select(*DECIDED.names), root, "decisions", batch_id)
    written = read_batch(spark, root, "decisions", DECIDED, batch_id)
    published = to_outbox(written, V.EVALUATED, F.col("evaluated_at"), F.lit(batch_id))
    write_batch(published, root, "outbox", batch_id, day_of="created_at")


def start_evaluation(
    frames: DataFrame,
    root: str,
    cfg: RiskConfig = RiskConfig(),
    trigger: dict | None = None,
    state: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start the query over received events.

    `state` goes to `stream_velocity` (`{"idle_seconds": ...}` lets the state
    of idle accounts go), `options` to `evaluate_batch`.
    """
    received = valid_rows(validate_events(frames.filter(F.col("event_type") == V.RECEIVED)))
    features = stream_velocity(received.select(*TRANSACTION_COLUMNS), cfg, **(state or {}))
    writer = features.writeStream.outputMode("append").foreachBatch(
        lambda rows, batch_id: evaluate_batch(rows, batch_id, root, cfg, **options)
    )
    with data_batches_only(frames.sparkSession) if (state or {}).get("idle_seconds") is not None else nullcontext():
        return _start(writer, f"{root}/checkpoints/evaluation", trigger)


def start_side_outputs(frames: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Start the query that keeps rejected events and records published decisions."""
    def keep(rows: DataFrame, batch_id: int) -> None:
        with releasing():
            # Decoded once; of valid rows only the evaluated ones are read again.
            rows = cut(rows.filter(F.col("reject_reason").isNotNull() | (F.col("event_type") == V.EVALUATED)))
            write_batch(rejected_rows(rows).select(*REJECTS.names), root, "rejects", batch_id)
            write_batch(audit_log(valid_rows(rows)), root, "audit", batch_id)

    writer = validate_events(frames).writeStream.outputMode("append").foreachBatch(keep)
    return _start(writer, f"{root}/checkpoints/side_outputs", trigger)


def relay_outbox(
    outbox: DataFrame, root: str, trigger: dict | None = None, format: str = "parquet", **options: str
) -> StreamingQuery:
    """Start the query from outbox rows to stream records, a topic or files."""
    writer = route_outbox(outbox).writeStream.outputMode("append").format(format).options(**options)
    return _start(writer, f"{root}/checkpoints/relay", trigger)


def _start(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def run_stream(spark: SparkSession, frames: DataFrame, root: str, cfg: RiskConfig = RiskConfig(), **options) -> None:
    """Work off everything there is and stop: side outputs, then the evaluation."""
    now = {"availableNow": True}
    for query in (
        start_side_outputs(frames, root, now),
        start_evaluation(frames, root, cfg, trigger=now, **options),
    ):
        query.awaitTermination()
