"""Properties over generated rows; each example is one DataFrame of many rows."""

import re
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig, seconds
from riskweave.operators.outbox import evaluated_payload, received_payload
from riskweave.operators.redact import redact_transactions, redaction_faults
from riskweave.operators.validate import decode_evaluated, decode_received
from riskweave.schemas import DECIDED, DECISION_COLUMNS, TRANSACTION_COLUMNS, TRANSACTIONS

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

accounts = st.from_regex(r"\A[A-Z]{2}[0-9]{10}\Z")
amounts = st.decimals(0, 999_999, places=4)
texts = st.one_of(
    st.sampled_from(["Normal payment", "Pay to user@example.com", "SSN 123-45-6789 holder", "Call 555-123-4567 to confirm"]),
    st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40),
)
instants = st.datetimes(datetime(1990, 1, 1), datetime(2090, 1, 1), timezones=st.just(timezone.utc))
rows = st.lists(st.tuples(amounts, accounts, accounts, texts, instants), min_size=20, max_size=60)


def table(spark, generated):
    return spark.createDataFrame([
        (f"00000000-0000-0000-0000-{n:012d}", amount, "USD", a, b, text, ts)
        for n, (amount, a, b, text, ts) in enumerate(generated)
    ], TRANSACTIONS)


@few
@given(rows)
def test_redaction_keeps_amount_id_and_time_and_leaks_no_account(spark, generated):
    tx = table(spark, generated)
    redacted = redact_transactions(tx)
    assert redaction_faults(redacted).isEmpty()
    for before, after in zip(tx.collect(), redacted.collect()):
        assert (before.id, before.amount, before.occurred_at) == (after.id, after.amount, after.occurred_at)
        hidden = (after.redacted_from_account, after.redacted_to_account, after.redacted_description)
        for account in (before.from_account, before.to_account):
            assert all(account not in value for value in hidden)
        assert not re.search(V.SSN_PATTERN, after.redacted_description)
        assert not re.search(V.EMAIL_PATTERN, after.redacted_description)


@few
@given(rows)
def test_received_payloads_decode_to_the_same_transaction(spark, generated):
    tx = table(spark, generated)
    frames = tx.select(F.lit(V.RECEIVED).alias("event_type"), received_payload().alias("value"))
    assert sorted(map(tuple, decode_received(frames).collect())) == sorted(map(tuple, tx.select(*TRANSACTION_COLUMNS).collect()))


@few
@given(rows, st.sampled_from(V.DECISIONS), st.decimals(0, 100, places=2), texts)
def test_evaluated_payloads_decode_to_the_same_decision(spark, generated, decision, score, reasoning):
    tx = table(spark, generated).withColumns({
        "decision": F.lit(decision), "risk_score": F.lit(score).cast("decimal(5,2)"), "reasoning": F.lit(reasoning),
        "evaluated_at": F.col("occurred_at"),
    }).select(*DECIDED.names)
    frames = tx.select(F.lit(V.EVALUATED).alias("event_type"), evaluated_payload().alias("value"))
    decoded = decode_evaluated(frames).select(*TRANSACTION_COLUMNS, *DECISION_COLUMNS)
    assert sorted(map(tuple, decoded.collect())) == sorted(map(tuple, tx.collect()))


@few
@given(st.lists(st.text(st.characters(codec="ascii", exclude_characters="\x00"), max_size=14), min_size=30, max_size=60))
def test_account_format(spark, names):
    names = [*names, "GB1234567890", "gb1234567890", "GB123456789", "GB12345678901", "GB1234567890\n", "\nGB1234567890"]
    got = spark.createDataFrame([(n,) for n in names], "a string").select(F.col("a").rlike(V.ACCOUNT_PATTERN)).collect()
    assert [r[0] for r in got] == [bool(re.fullmatch(r"[A-Z]{2}[0-9]{10}", n)) for n in names]


def test_settings():
    assert RiskConfig.from_settings({}) == RiskConfig()
    cfg = RiskConfig.from_settings({
        "amount-threshold": 5000, "velocity-limit": 3, "velocity-window": "PT30M", "rag-max-results": 7,
        "history-limit": 9, "weights": {"rule-gate": 0.1, "rag": 0.2, "llm": 0.7},
        "thresholds": {"approve-max": 20, "flag-max": 60}})
    assert cfg == RiskConfig(Decimal("5000"), 3, 1800, 7, 9, 0.1, 0.2, 0.7, 20, 60)
    assert [seconds(d) for d in ("PT1H", "P7D", "P1DT1H1M1S")] == [3600, 604_800, 90_061]
    for bad in ("1h", "P", "PT", ""):
        with pytest.raises(ValueError):
            seconds(bad)
