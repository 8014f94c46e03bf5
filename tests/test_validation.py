"""Events and requests, one bad field at a time."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskweave.operators import validate as v
from riskweave.sources.streams import frames_of

GOOD = {
    "id": "123e4567-e89b-12d3-a456-426614174000", "amount": 1500.0, "currency": "USD", "fromAccount": "GB1234567890",
    "toAccount": "US9876543210", "description": "Test payment", "occurredAt": "2026-02-13T00:00:00Z",
}
DECISION = {"decision": "FLAG", "riskScore": 41.25, "reasoning": "why", "evaluatedAt": "2026-02-13T00:00:01Z"}


def reason(spark, value, event_type="TransactionReceived"):
    frames = spark.createDataFrame([(event_type, value)], "event_type string, value string")
    return v.validate_events(frames).first().reject_reason


def changed(**fields):
    return json.dumps({k: x for k, x in {**GOOD, **fields}.items() if x is not ...})


@pytest.mark.parametrize("value, event_type, expected", [
    (changed(), "TransactionReceived", None),
    (changed(amount=0), "TransactionReceived", None),
    (changed(extra="ignored"), "TransactionReceived", None),
    (changed(description=""), "TransactionReceived", None),
    (changed(id="1-2-3-4-5"), "TransactionReceived", None),
    (changed(), None, v.NO_TYPE),
    (changed(), "TransactionDeleted", v.BAD_TYPE),
    ("invalid json", "TransactionReceived", v.BAD_JSON),
    (None, "TransactionReceived", v.BAD_JSON),
    ("", "TransactionReceived", v.BAD_JSON),
    (changed(amount="lots"), "TransactionReceived", v.BAD_JSON),
    (changed(amount=True), "TransactionReceived", v.BAD_JSON),
    (changed() + " trailing", "TransactionReceived", v.BAD_JSON),
    (changed() + " \n", "TransactionReceived", None),
    (changed().replace('"', "'"), "TransactionReceived", v.BAD_JSON),
    ("[" + changed() + "]", "TransactionReceived", v.BAD_JSON),
    ("null", "TransactionReceived", v.BAD_JSON),
    (changed(amount="12.5"), "TransactionReceived", None),
    (changed(amount=-0.00001), "TransactionReceived", v.BAD_AMOUNT),
    (changed(amount=10 ** 15), "TransactionReceived", v.LARGE_AMOUNT),
    (changed(id="nope"), "TransactionReceived", v.BAD_ID),
    (changed(id=...), "TransactionReceived", v.BAD_ID),
    (changed(amount=...), "TransactionReceived", v.NO_AMOUNT),
    (changed(amount=-500), "TransactionReceived", v.BAD_AMOUNT),
    (changed(currency="ZZZ"), "TransactionReceived", v.BAD_CURRENCY),
    (changed(currency="usd"), "TransactionReceived", v.BAD_CURRENCY),
    (changed(currency=None), "TransactionReceived", v.BAD_CURRENCY),
    (changed(fromAccount="invalid-account"), "TransactionReceived", v.BAD_ACCOUNT),
    (changed(toAccount="GB1234567890\n"), "TransactionReceived", v.BAD_ACCOUNT),
    (changed(toAccount="GB123456789"), "TransactionReceived", v.BAD_ACCOUNT),
    (changed(toAccount="gb1234567890"), "TransactionReceived", v.BAD_ACCOUNT),
    (changed(toAccount=None), "TransactionReceived", v.BAD_ACCOUNT),
    (changed(description=...), "TransactionReceived", v.NO_DESCRIPTION),
    (changed(occurredAt="2026-02-13"), "TransactionReceived", v.BAD_TIME),
    (changed(occurredAt=...), "TransactionReceived", v.BAD_TIME),
    (changed(**DECISION), "TransactionEvaluated", None),
    (changed(**{**DECISION, "riskScore": 100}), "TransactionEvaluated", None),
    (changed(**{**DECISION, "decision": "MAYBE"}), "TransactionEvaluated", v.BAD_DECISION),
    (changed(), "TransactionEvaluated", v.BAD_DECISION),
    (changed(**{**DECISION, "riskScore": 100.01}), "TransactionEvaluated", v.BAD_SCORE),
    (changed(**{**DECISION, "riskScore": 100.001}), "TransactionEvaluated", v.BAD_SCORE),
    (changed(**{**DECISION, "riskScore": -0.01}), "TransactionEvaluated", v.BAD_SCORE),
    (changed(**{**DECISION, "riskScore": None}), "TransactionEvaluated", v.BAD_SCORE),
    (changed(**{**DECISION, "evaluatedAt": "later"}), "TransactionEvaluated", v.BAD_TIME),
])
def test_event_reasons(spark, value, event_type, expected):
    assert reason(spark, value, event_type) == expected


def test_split_loses_nothing(spark):
    frames = spark.createDataFrame(
        [("TransactionReceived", changed()), (None, changed()), ("TransactionReceived", "x"),
         ("TransactionEvaluated", changed(**DECISION))], "event_type string, value string")
    validated = v.validate_events(frames)
    assert v.valid_rows(validated).count() == 2 and v.rejected_rows(validated).count() == 2
    assert {r.route: r["count"] for r in v.route_events(frames).groupBy("route").count().collect()} == {
        "received": 1, "evaluated": 1, "rejected": 2}
    received, evaluated = v.decode_received(frames).first(), v.decode_evaluated(frames).first()
    assert received.amount == Decimal("1500.0000") and received.from_account == "GB1234567890"
    assert (evaluated.decision, evaluated.risk_score) == ("FLAG", Decimal("41.25"))


def test_header_gives_the_event_type(spark):
    records = spark.sql("""
        select cast('k' as binary) key, cast('v' as binary) value, timestamp '2024-01-01' timestamp,
         array(named_struct('key', 'other', 'value', cast('x' as binary)),
               named_struct('key', 'eventType', 'value', cast('TransactionReceived' as binary))) headers
        union all select cast('k' as binary), cast('v' as binary), timestamp '2024-01-01', null
        union all select cast('k' as binary), cast('v' as binary), timestamp '2024-01-01', array()""")
    assert [r.event_type for r in frames_of(records).collect()] == ["TransactionReceived", None, None]


@pytest.mark.parametrize("row, expected", [
    (("10.00", "USD", "GB1234567890", "US9876543210", "x"), []),
    (("-50", "USD", "GB1234567890", "US9876543210", "x"), ["amount not positive"]),
    (("0", "USD", "GB1234567890", "US9876543210", "x"), ["amount not positive"]),
    ((None, " ", None, "", None),
     ["missing amount", "blank currency", "blank from account", "blank to account"]),
    (("1", "ZZZ", "bad", "US9876543210", "x"), ["unknown currency"]),
    (("1", "USD", "bad", "US9876543210", "x"), ["invalid account"]),
    (("1", "USD", "GB1234567890", "US9876543210", None), ["missing description"]),
])
def test_requests(spark, row, expected):
    requests = spark.createDataFrame(
        [row], "amount string, currency string, from_account string, to_account string, description string"
    ).withColumn("amount", F.col("amount").cast("decimal(19,4)"))
    assert v.validate_requests(requests).first().reject_reasons == expected


def test_request_ids_repeat_for_the_same_source_row(spark):
    rows = spark.range(50).selectExpr(
        "id as n", "cast(1 as decimal(19,4)) amount", "'USD' currency", "'GB1234567890' from_account",
        "'US9876543210' to_account", "'x' description")
    first, again = (
        [r.id for r in v.request_to_transaction(rows, F.col("n"), F.lit("2024-01-01").cast("timestamp")).collect()]
        for _ in range(2))
    assert first == again and len(set(first)) == 50 and all(len(i) == 36 for i in first)
