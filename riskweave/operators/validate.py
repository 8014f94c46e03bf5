"""Decoding and validation of events and requests.

Each input row is decoded once and gets a reason if it is not valid; valid
and rejected rows are two filters over that one result, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import fixed_values as V
from riskweave.functions.text import canonical_uuid, parse_instant, uuid_of
from riskweave.schemas import AMOUNT, DECISION_COLUMNS, EVALUATED_PAYLOAD, SCORE, TRANSACTION_COLUMNS

_CORRUPT = "_corrupt"
_WIRE = T.StructType(EVALUATED_PAYLOAD.fields + [T.StructField(_CORRUPT, T.StringType())])

# Reasons in the order in which the rules are tried.
NO_TYPE = "missing event type"
BAD_TYPE = "unknown event type"
BAD_JSON = "unparseable payload"
BAD_ID = "invalid id"
NO_AMOUNT = "missing amount"
BAD_AMOUNT = "negative amount"
LARGE_AMOUNT = "amount out of range"
BAD_CURRENCY = "unknown currency"
BAD_ACCOUNT = "invalid account"
NO_DESCRIPTION = "missing description"
BAD_TIME = "invalid time"
BAD_DECISION = "invalid decision"
BAD_SCORE = "invalid risk score"


def _first(rules: Iterable[tuple[Column, str]]) -> Column:
    """Name of the first rule that is broken; a condition that is null counts as broken."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(reason)) for broken, reason in rules])


def _known_currency(code: Column, codes: Iterable[str]) -> Column:
    return code.isin(list(codes))


def _is_account(account: Column) -> Column:
    return account.rlike(V.ACCOUNT_PATTERN)


def event_type_of(headers: Column) -> Column:
    """The event type header of a stream record, or null."""
    found = F.filter(headers, lambda h: h["key"] == V.EVENT_TYPE_HEADER)
    return F.get(found, F.lit(0))["value"].cast("string")


def validate_events(frames: DataFrame, currencies: Iterable[str] = V.CURRENCY_CODES + V.HISTORIC_CURRENCY_CODES) -> DataFrame:
    """Adds the decoded columns and `reject_reason`, null on valid rows.

    Needs `event_type` and `value` (JSON text); other columns pass through.
    Decision columns are filled for evaluated events only.
    """
    wire = F.from_json(
        F.col("value"), _WIRE,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"},
    )
    evaluated = F.col("event_type") == V.EVALUATED
    # Expanding a one-element array keeps the parsed payload one value: plain
    # columns would be inlined into every rule and parsed once for each.
    decoded = frames.withColumn("_w", F.explode(F.array(wire))).withColumns({
        "id": canonical_uuid(F.col("_w.id")),
        "amount": F.col("_w.amount").try_cast(AMOUNT),
        "currency": F.col("_w.currency"),
        "from_account": F.col("_w.fromAccount"),
        "to_account": F.col("_w.toAccount"),
        "description": F.col("_w.description"),
        "occurred_at": parse_instant(F.col("_w.occurredAt")),
        "decision": F.when(evaluated, F.col("_w.decision")),
        "risk_score": F.when(evaluated, F.col("_w.riskScore").try_cast(SCORE)),
        "reasoning": F.when(evaluated, F.col("_w.reasoning")),
        "evaluated_at": F.when(evaluated, parse_instant(F.col("_w.evaluatedAt"))),
    })
    only = F.coalesce(evaluated, F.lit(False))
    reason = _first([
        (F.col("event_type").isNull(), NO_TYPE),
        (~F.col("event_type").isin(*V.EVENT_TYPES), BAD_TYPE),
        (F.col("_w").isNull() | F.col(f"_w.{_CORRUPT}").isNotNull() | ~F.col("value").rlike(r"\}\s*\z"), BAD_JSON),
        (F.col("id").isNull(), BAD_ID),
        (F.col("_w.amount").isNull(), NO_AMOUNT),
        (F.col("_w.amount") < 0, BAD_AMOUNT),
        (F.col("amount").isNull(), LARGE_AMOUNT),
        (~_known_currency(F.col("currency"), currencies), BAD_CURRENCY),
        (~(_is_account(F.col("from_account")) & _is_account(F.col("to_account"))), BAD_ACCOUNT),
        (F.col("description").isNull(), NO_DESCRIPTION),
        (F.col("occurred_at").isNull(), BAD_TIME),
        (only & ~F.coalesce(F.col("decision").isin(*V.DECISIONS) & F.col("reasoning").isNotNull(), F.lit(False)),
         BAD_DECISION),
        (only & ~F.coalesce(F.col("_w.riskScore").between(0, V.MAX_SCORE), F.lit(False)), BAD_SCORE),
        (only & F.col("evaluated_at").isNull(), BAD_TIME),
    ])
    return decoded.withColumn("reject_reason", reason).drop("_w")


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_reason").isNotNull())


def reject_counts(validated: DataFrame) -> DataFrame:
    """Rows per reason, `ok` for the valid ones."""
    return validated.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def decode_received(frames: DataFrame) -> DataFrame:
    """Transactions of the valid received events."""
    rows = valid_rows(validate_events(frames.filter(F.col("event_type") == V.RECEIVED)))
    return rows.select(*TRANSACTION_COLUMNS)


def decode_evaluated(frames: DataFrame) -> DataFrame:
    """Transactions with decisions of the valid evaluated events."""
    rows = valid_rows(validate_events(frames.filter(F.col("event_type") == V.EVALUATED)))
    return rows.select(*TRANSACTION_COLUMNS, *DECISION_COLUMNS)


def route_events(frames: DataFrame) -> DataFrame:
    """Every row with the branch it takes: `received`, `evaluated` or `rejected`."""
    validated = validate_events(frames)
    return validated.withColumn(
        "route",
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(F.col("event_type") == V.RECEIVED, "received").otherwise("evaluated"),
    )


def validate_requests(requests: DataFrame, currencies: Iterable[str] = V.CURRENCY_CODES + V.HISTORIC_CURRENCY_CODES) -> DataFrame:
    """Adds `reject_reasons`: every failing field of an API-shaped row, empty if it is valid.

    Field rules are all reported; only a row that passes them is checked for
    currency, account format and description.
    """
    def blank(name: str) -> Column:
        return F.coalesce(~F.col(name).rlike(V.NOT_BLANK_PATTERN), F.lit(True))

    fields = F.filter(
        F.array(
            F.when(F.col("amount").isNull(), NO_AMOUNT).when(F.col("amount") <= 0, "amount not positive"),
            F.when(blank("currency"), "blank currency"),
            F.when(blank("from_account"), "blank from account"),
            F.when(blank("to_account"), "blank to account"),
        ),
        lambda r: r.isNotNull(),
    )
    domain = _first([
        (~_known_currency(F.col("currency"), currencies), BAD_CURRENCY),
        (~(_is_account(F.col("from_account")) & _is_account(F.col("to_account"))), BAD_ACCOUNT),
        (F.col("description").isNull(), NO_DESCRIPTION),
    ])
    return requests.withColumn("_fields", fields).withColumn(
        "reject_reasons",
        F.when(F.size("_fields") > 0, F.col("_fields"))
        .when(domain.isNotNull(), F.array(domain))
        .otherwise(F.array().cast("array<string>")),
    ).drop("_fields")


def request_to_transaction(requests: DataFrame, source_key: Column, clock: Column) -> DataFrame:
    """Valid requests as transactions; the id derives from the key of the source row."""
    return requests.select(
        uuid_of(source_key.cast("string")).alias("id"),
        F.col("amount").cast(AMOUNT).alias("amount"),
        "currency", "from_account", "to_account", "description",
        clock.alias("occurred_at"),
    )
