"""Shapes of physical plans that must not get lost."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SF
from riskweave.config import RiskConfig
from riskweave.operators import activity, tables
from riskweave.plans import fixtures, registered
from riskweave.plans.evaluate import gate


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


STREAMS = {"read_event_stream", "read_outbox_stream", "relay_outbox", "stream_velocity", "stream_velocity_open",
           "run_stream", "reject_stream", "audit_stream", "redelivery", "purge_outbox", "compact_store"}


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - STREAMS))
def test_no_nested_loops_or_row_udfs(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("NestedLoop", "CartesianProduct", "BatchEvalPython"):
        assert bad not in text


def test_gate_shuffles_once(spark):
    assert plan(gate(fixtures.transactions(spark, SF), registered.CFG)).count("Exchange") == 1


def test_time_bound_reaches_the_scan(spark, make, tmp_path):
    make([(1, 1, 2, 0, 10)]).write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    text = plan(activity.velocity_as_of(stored, registered.instant("2024-01-15 12:00:00")))
    assert "GreaterThan(occurred_at,2024-01-15 11:00:00.0)" in text
    scan = text[text.index("ReadSchema"):]
    assert "description" not in scan and "amount" not in scan


@pytest.mark.parametrize("make_rows", [
    lambda spark: activity.recent_transactions(fixtures.transactions(spark, SF)),
    lambda spark: tables.upsert_latest(fixtures.deliveries(spark, SF)),
    lambda spark: entry.queries()["knn"](spark, SF),
])
def test_rank_limits_apply_before_the_shuffle(spark, make_rows):
    text = plan(make_rows(spark))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit") and text.count("WindowGroupLimit") == 2


def test_velocity_reads_four_columns_only(spark):
    text = plan(registered.queries()["velocity"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text


def test_price_lookup_is_no_join(spark):
    text = plan(entry.queries()["llm_cost"](spark, SF))
    assert "Join" not in text and "Exchange" not in text


def test_validation_parses_each_payload_once(spark):
    text = plan(entry.queries()["decode_received"](spark, SF))
    assert text.count("from_json") == 1


def test_split_plan_spreads_a_busy_account(spark):
    cfg = RiskConfig(hot_account_rows=10)
    tx = fixtures.transactions(spark, SF)
    text = plan(activity.account_features(tx, cfg))
    assert "slot" in text


def test_evaluation_computes_features_once(spark):
    text = plan(entry.queries()["evaluate"](spark, SF))
    assert text.count("Window [") == 0 or text.count("Window [") <= 4
