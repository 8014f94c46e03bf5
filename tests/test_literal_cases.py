"""Single cases with known answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.text import canonical_uuid, iso_instant, parse_instant, pseudonym, scrub, transaction_text
from riskweave.operators.cost import llm_cost
from riskweave.operators.redact import redact_transactions, redaction_faults
from riskweave.operators.rules import gate_faults, rule_gate
from riskweave.operators.scoring import amount_points, assess, decision_faults, history_risk, score, similarity_points
from riskweave.schemas import SCORE


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("amount, count, text, decision, points, reason", [
    (100, 0, "Normal payment", "APPROVE", "10.00", V.DEFAULT_REASON),
    (10000, 2, "Normal payment", "APPROVE", "10.00", V.DEFAULT_REASON),
    (500, 10, "Normal payment", "APPROVE", "10.00", V.DEFAULT_REASON),
    (500, 11, "x", "FLAG", "50.00", "High velocity: 11 transactions exceed limit of 10"),
    (15000, 15, "x", "FLAG", "50.00", "High velocity: 15 transactions exceed limit of 10"),
    (12000, 1, "x", "FLAG", "50.00", "High amount: 12000.0000 exceeds threshold of 10000"),
    (50000, 20, "Money launder operation", "BLOCK", "95.00",
     "Sanctioned pattern detected: (?i)money\\s*launder"),
    (1, 0, "a TERRORIST sanction violation", "BLOCK", "95.00", "Sanctioned pattern detected: (?i)terrorist"),
    (1, 0, "SANCTIONS   VIOLATION", "BLOCK", "95.00", "Sanctioned pattern detected: (?i)sanctions?\\s*violation"),
    (1, 0, "illicitfunds", "BLOCK", "95.00", "Sanctioned pattern detected: (?i)illicit\\s*fund"),
    (1, 0, "", "APPROVE", "10.00", V.DEFAULT_REASON),
])
def test_rule_gate(make, amount, count, text, decision, points, reason):
    rows = make([(1, 1, 2, 0, amount, text)]).withColumn("velocity", F.lit(count).cast("bigint"))
    gated = rule_gate(rows, RiskConfig())
    row = one(gated)
    assert (row.gate_decision, row.gate_score, row.gate_reason) == (decision, Decimal(points), reason)
    assert gate_faults(gated).isEmpty()


@pytest.mark.parametrize("text, expected", [
    ("Payment to john.doe@example.com for services", "Payment to [REDACTED_EMAIL] for services"),
    ("SSN: 123-45-6789 on file", "SSN: [REDACTED_SSN] on file"),
    ("Contact: (555) 123-4567", "Contact: [REDACTED_PHONE]"),
    ("From john@test.com, SSN 123-45-6789, call 555-123-4567",
     "From [REDACTED_EMAIL], SSN [REDACTED_SSN], call [REDACTED_PHONE]"),
    ("ref 12345678901", "ref [REDACTED_PHONE]"),
    ("Normal payment for groceries", "Normal payment for groceries"),
    ("", ""),
])
def test_scrub(spark, text, expected):
    assert one(spark.createDataFrame([(text,)], "t string").select(scrub(F.col("t")).alias("r"))).r == expected


def test_redacted_transaction(make):
    rows = make([(7, 1, 2, 5, "12.3400", "mail a@b.org")])
    redacted = redact_transactions(rows)
    row = one(redacted)
    assert redacted.columns == ["id", "amount", "redacted_from_account", "redacted_to_account",
                                "redacted_description", "occurred_at"]
    assert row.amount == Decimal("12.3400") and row.redacted_description == "mail [REDACTED_EMAIL]"
    assert redaction_faults(redacted).isEmpty()


def test_pseudonym_is_stable(spark):
    rows = spark.createDataFrame([("GB1234567890",), ("GB1234567890",), ("US9876543210",)], "a string")
    names = [r.p for r in rows.select(pseudonym(F.col("a")).alias("p")).collect()]
    assert names[0] == names[1] == "903d3cb9" and names[2] != names[0]


def test_transaction_text(spark):
    row = spark.createDataFrame(
        [(Decimal("1500"), "USD", "GB1234567890", "US9876543210", "Monthly rent payment")],
        "amount decimal(19,4), currency string, from_account string, to_account string, description string")
    assert one(row.select(transaction_text().alias("t"))).t == (
        "1500.0000 USD from GB1234567890 to US9876543210: Monthly rent payment")


@pytest.mark.parametrize("text, expected", [
    ("2026-02-13T00:00:00Z", "2026-02-13T00:00:00Z"),
    ("2026-02-13T00:00:00.5Z", "2026-02-13T00:00:00.500Z"),
    ("2026-02-13T00:00:00.123456Z", "2026-02-13T00:00:00.123456Z"),
    ("2026-02-13T02:00:00+02:00", "2026-02-13T00:00:00Z"),
    ("2026-02-13", None), ("2026-02-13T00:00:00", None), ("2026-02-13T00:00Z", None), ("2026-13-13T00:00:00Z", None),
    ("2026-02-13T00:00:00Z\n", None), ("", None),
])
def test_instants(spark, text, expected):
    parsed = spark.createDataFrame([(text,)], "t string").select(parse_instant(F.col("t")).alias("ts"))
    assert one(parsed.select(iso_instant(F.col("ts")).alias("i"))).i == expected


@pytest.mark.parametrize("text, expected", [
    ("123E4567-E89B-12D3-A456-426614174000", "123e4567-e89b-12d3-a456-426614174000"),
    ("1-2-3-4-5", "00000001-0002-0003-0004-000000000005"),
    ("not-a-uuid", None), ("", None), ("123e4567e89b12d3a456426614174000", None),
    ("123e4567-e89b-12d3-a456-426614174000\n", None),
])
def test_uuids(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(canonical_uuid(F.col("t")).alias("u"))
    assert one(row).u == expected


@pytest.mark.parametrize("model, tokens_in, tokens_out, cost", [
    ("gpt-4o", 1000, 1000, "0.0125"),
    ("gpt-4o-mini", 1000, 1000, "0.00075"),
    ("gpt-3.5-turbo", 1000, 0, "0.0005"),
    ("gpt-4o-2024-08-06", 1000, 0, "0.0025"),
    ("gpt-4o-mini-2024-07-18", 1000, 0, "0.00015"),
    ("gpt-4-turbo-preview", 1000, 0, "0.01"),
    ("gpt-4-0613", 1000, 0, "0.03"),
    ("text-embedding-3-small", 1000, 0, "0.00002"),
    ("unknown", 1000, 1000, "0"),
    (None, 1000, 1000, "0"),
    ("gpt-4o", 0, 0, "0"),
])
def test_cost(spark, model, tokens_in, tokens_out, cost):
    usage = spark.createDataFrame([(model, tokens_in, tokens_out)], "model string, input_tokens long, output_tokens long")
    row = one(llm_cost(usage))
    assert row.cost_usd == Decimal(cost)
    assert row.emitted_cost_usd == (Decimal(cost) if Decimal(cost) else None)


def test_prices_from_a_table(spark):
    """The longest name that holds on the day; a new price needs no code."""
    prices = spark.createDataFrame([
        ("m", "1", "0", None, "2024-02-01"), ("m", "2", "0", "2024-02-01", None), ("m-large", "5", "1", "2024-02-05", None), ("m-l", "3", "0", None, None),
    ], "name string, price_in string, price_out string, valid_from string, valid_to string").selectExpr(
        "name", "price_in", "price_out", "cast(valid_from as date) valid_from", "cast(valid_to as date) valid_to")
    calls = [("m", "2024-01-31", 1), ("m", "2024-02-01", 2), ("m-large-9", "2024-02-04", 3), ("m-large-9", "2024-02-05", 6), ("x", "2024-01-01", 0), (None, "2024-01-01", 0)]
    usage = spark.createDataFrame([(m, d, 1000, 1000) for m, d, _ in calls], "model string, d string, input_tokens long, output_tokens long")
    usage = usage.selectExpr("model", "cast(d as date) day", "input_tokens", "output_tokens")
    found = {(r.model, str(r.day)): r.cost_usd for r in llm_cost(usage, prices, at="day").collect()}
    assert found == {(m, d): Decimal(cost) for m, d, cost in calls}
    now = {r.model: r.cost_usd for r in llm_cost(usage.drop("day").distinct(), prices).collect()}
    assert now == {"m": 2, "m-large-9": 6, "x": 0, None: 0}


def flagged(spark, amount, **columns):
    row = spark.range(1).select(
        F.lit("00000000-0000-0000-0000-000000000001").alias("id"), F.lit(Decimal(amount)).cast("decimal(19,4)").alias("amount"),
        F.lit("US0000000001").alias("from_account"), F.lit("US0000000002").alias("to_account"),
        F.lit("text").alias("description"), F.current_timestamp().alias("occurred_at"),
        F.lit("FLAG").alias("gate_decision"), F.lit("why").alias("gate_reason"), F.lit("50").cast(SCORE).alias("gate_score"),
        F.lit(0).cast("bigint").alias("history_count"), F.lit(None).cast("decimal(29,4)").alias("history_sum"),
    )
    return row.withColumns(columns)


def scored(rows, risk, history):
    return score(
        rows.withColumns({
            "assessment_risk": F.lit(risk).cast(SCORE), "history_risk": F.lit(history).cast(SCORE),
            "assessment_reasoning": F.lit("model says"),
        }))


@pytest.mark.parametrize("risk, history, expected, decision", [
    ("40.00", "37.50", "41.25", "FLAG"),
    ("0", "0", "10.00", "APPROVE"),
    ("38.00", "3.30", "29.99", "APPROVE"),
    ("38.00", "3.33", "30.00", "FLAG"),
    ("90.00", "49.98", "69.99", "FLAG"),
    ("90.00", "50.00", "70.00", "BLOCK"),
    ("100.00", "100.00", "90.00", "BLOCK"),
])
def test_score(spark, risk, history, expected, decision):
    result = scored(flagged(spark, "15000"), risk, history)
    row = one(result)
    assert (row.risk_score, row.decision) == (Decimal(expected), decision)
    assert row.reasoning == (
        f"Rule gate: why | LLM: model says | History: 0 recent transactions | Weighted score: {expected}")
    assert decision_faults(result).isEmpty()


@pytest.mark.parametrize("a, h, expected, reasoning", [
    (False, False, "50.00", "Rule gate: why | Weighted score: 50.00"),
    (True, False, "42.86", "Rule gate: why | LLM: model says | Weighted score: 42.86"),
    (False, True, "42.50", "Rule gate: why | History: 0 recent transactions | Weighted score: 42.50"),
    (None, None, "50.00", "Rule gate: why | Weighted score: 50.00"),
])
def test_missing_parts(spark, a, h, expected, reasoning):
    rows = flagged(spark, "15000", assessment_ok=F.lit(a).cast("boolean"), history_ok=F.lit(h).cast("boolean"))
    row = one(scored(rows, "40.00", "37.50"))
    assert (row.risk_score, row.reasoning) == (Decimal(expected), reasoning)


@pytest.mark.parametrize("count, total, amount, expected", [
    (0, None, "15000", "60.00"),
    (3, "0", "15000", "50.00"),
    (1, "12000", "15000", "37.50"),
    (2, "10000", "5000", "30.00"),
    (4, "40000", "1", "0.00"),
    (1, "100", "100000", "100.00"),
    (3, "10000", "4567.8900", "41.11"),
])
def test_history_risk(spark, count, total, amount, expected):
    rows = flagged(spark, amount, history_count=F.lit(count).cast("bigint"), history_sum=F.lit(total).cast("decimal(29,4)"))
    assert one(history_risk(rows)).history_risk == Decimal(expected)


@pytest.mark.parametrize("amount, count, mean, risk, reasoning", [
    ("15000", 0, None, "85.00", "amount-based=75.0, similarity-adj=10.0, similar-count=0"),
    ("15000", None, None, "85.00", "amount-based=75.0, similarity-adj=10.0, similar-count=0"),
    ("15000", 1, 0.85, "58.00", "amount-based=75.0, similarity-adj=-17.0, similar-count=1"),
    ("50000", 2, 0.9125, "81.75", "amount-based=100.0, similarity-adj=-18.3, similar-count=2"),
    ("100", 5, 1.0, "0.00", "amount-based=0.5, similarity-adj=-20.0, similar-count=5"),
    ("19900", 0, None, "100.00", "amount-based=99.5, similarity-adj=10.0, similar-count=0"),
])
def test_assessment(spark, amount, count, mean, risk, reasoning):
    rows = flagged(spark, amount, similar_count=F.lit(count).cast("bigint"), similar_mean=F.lit(mean).cast("double"))
    row = one(assess(rows))
    assert row.assessment_ok and row.assessment_risk == Decimal(risk)
    assert row.assessment_reasoning == f"[Stub] Heuristic: {reasoning}"


def test_points_keep_two_places(spark):
    row = one(spark.range(1).select(
        amount_points(F.lit(Decimal("1.0000")).cast("decimal(19,4)")).alias("a"),
        similarity_points(F.lit(1), F.lit(0.00025)).alias("s")))
    assert row.a == Decimal("0.01") and row.s == Decimal("-0.01")


def test_model_sees_redacted_rows_only_and_bad_answers_count_as_missing(spark):
    seen = []

    def model(redacted, count, mean):
        seen.extend([redacted, count, mean])
        return F.struct(F.lit(Decimal("120.00")).alias("risk"), redacted["redacted_description"].alias("reasoning"))

    rows = flagged(spark, "15000", similar_count=F.lit(0), similar_mean=F.lit(None).cast("double"),
                   description=F.lit("write to a@b.org"))
    row = one(assess(rows, model))
    assert not row.assessment_ok and row.assessment_reasoning == "write to [REDACTED_EMAIL]"
    fields = rows.select(seen[0].alias("r")).schema["r"].dataType.names
    assert "from_account" not in fields and "description" not in fields


def test_a_model_that_fails_or_is_slow_has_no_answer(spark):
    import time

    from riskweave.operators.scoring import model_of

    def analyze(redacted, similar):
        if similar is not None and redacted["redacted_description"] == "fails":
            raise RuntimeError("no answer")
        if redacted["redacted_description"] == "slow":
            time.sleep(20)
        return 41.5, f"{len(similar)} alike"

    rows = flagged(spark, "15000", similar_count=F.lit(0), similar_mean=F.lit(None).cast("double"),
                   similar=F.lit(None).cast("array<struct<amount:decimal(19,4)>>"))
    for description, ok in (("fine", True), ("fails", False), ("slow", False)):
        row = one(assess(rows.withColumn("description", F.lit(description)), model_of(analyze, timeout_seconds=3)))
        assert row.assessment_ok == ok
        assert (row.assessment_risk, row.assessment_reasoning) == ((Decimal("41.50"), "0 alike") if ok else (None, None))
