"""Outbox rows: payloads, routing, retention, and the audit table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions.text import iso_instant, uuid_of
from riskweave.schemas import DECISION_COLUMNS, SCORE, TRANSACTION_COLUMNS


def _received_fields() -> list[Column]:
    return [
        F.col("id"), F.col("amount"), F.col("currency"),
        F.col("from_account").alias("fromAccount"), F.col("to_account").alias("toAccount"),
        F.col("description"), iso_instant(F.col("occurred_at")).alias("occurredAt"),
    ]


def _evaluated_fields() -> list[Column]:
    return _received_fields() + [
        F.col("decision"), F.col("risk_score").alias("riskScore"),
        F.col("reasoning"), iso_instant(F.col("evaluated_at")).alias("evaluatedAt"),
    ]


def received_payload() -> Column:
    return F.to_json(F.struct(*_received_fields()), {"ignoreNullFields": "false"})


def evaluated_payload() -> Column:
    return F.to_json(F.struct(*_evaluated_fields()), {"ignoreNullFields": "false"})


def to_outbox(rows: DataFrame, event_type: str, created_at: Column, batch: Column | None = None) -> DataFrame:
    """One outbox row per event.

    Ids derive from event type, transaction and batch, and the clock is an
    argument: a batch that runs again writes the same rows.
    """
    payload = received_payload() if event_type == V.RECEIVED else evaluated_payload()
    batch = F.lit("") if batch is None else batch.cast("string")
    return rows.select(
        uuid_of(F.lit(event_type), F.col("id"), batch).alias("id"),
        F.lit(V.AGGREGATE_TYPE).alias("aggregate_type"),
        F.col("id").alias("aggregate_id"),
        F.lit(event_type).alias("event_type"),
        payload.alias("payload"),
        created_at.alias("created_at"),
    )


def route_outbox(outbox: DataFrame) -> DataFrame:
    """Outbox rows as stream records: topic, key, unchanged payload, event type as a header."""
    header = F.struct(
        F.lit(V.EVENT_TYPE_HEADER).alias("key"), F.col("event_type").cast("binary").alias("value")
    )
    return outbox.select(
        F.concat(F.lit(V.TOPIC_PREFIX), "aggregate_type").alias("topic"),
        F.col("aggregate_id").cast("binary").alias("key"),
        F.col("payload").cast("binary").alias("value"),
        F.array(header).alias("headers"),
        F.col("created_at").alias("timestamp"),
    )


def outbox_scores(outbox: DataFrame) -> DataFrame:
    """The risk score picked from the payload of evaluated events."""
    return outbox.filter(F.col("event_type") == V.EVALUATED).select(
        "event_type", "aggregate_id",
        F.get_json_object("payload", "$.riskScore").cast(SCORE).alias("score"),
    )


def outbox_cutoff(now: Column, days: int = V.OUTBOX_RETENTION_DAYS) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def outbox_retained(outbox: DataFrame, cutoff: Column) -> DataFrame:
    """What the purge keeps; a row exactly at the cutoff stays. Days before it are not read if there is a `day`."""
    kept = outbox.filter(F.col("created_at") >= cutoff)
    return kept.filter(F.col("day") >= F.to_date(cutoff)) if "day" in outbox.columns else kept


def outbox_purge_count(outbox: DataFrame, cutoff: Column) -> DataFrame:
    old = outbox.filter(F.col("created_at") < cutoff)
    if "day" in outbox.columns:
        old = old.filter(F.col("day") <= F.to_date(cutoff))
    return old.agg(F.count("*").alias("purged"))


def audit_log(evaluated: DataFrame) -> DataFrame:
    """Decisions as recorded; nothing is computed again."""
    return evaluated.select(*TRANSACTION_COLUMNS, *DECISION_COLUMNS)
