"""Velocity and history against brute force, with and without split accounts."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import activity as A

HOUR = 3_600_000_000


def brute(rows, cfg):
    """Velocity, history size and history sum by looking at every pair."""
    out = {}
    for n, a, _, us, *_ in rows:
        mine = [r for r in rows if a in (r[1], r[2])]
        before = sorted((r[3], r[0], Decimal(str(r[4]))) for r in mine if (r[3], r[0]) < (us, n))[-cfg.history_limit:]
        fast = sum(us - cfg.velocity_window_us < r[3] <= us for r in mine)
        out[n] = (fast, len(before), sum((b[2] for b in before), Decimal(0)) if before else None)
    return out


def got(df):
    return {int(r.id[-12:]): (r.velocity, r.history_count, r.history_sum) for r in df.collect()}


def skewed(seed, rows=400, span=6 * HOUR, ties=True):
    """Account 1 pays or receives in two thirds of all rows; many rows share an instant."""
    rng = random.Random(seed)
    step = 1_000_000 if ties else 1
    return [
        (n, 1 if rng.random() < 0.33 else rng.randint(2, 9), 1 if rng.random() < 0.33 else rng.randint(1, 9),
         rng.randrange(0, span, step * 30 if ties and rng.random() < 0.5 else step), rng.randint(0, 20000))
        for n in range(rows)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_usual_plan(make, seed):
    rows, cfg = skewed(seed), RiskConfig()
    assert got(A.account_features(make(rows), cfg)) == brute(rows, cfg)


@pytest.mark.parametrize("cfg", [
    RiskConfig(hot_account_rows=100, hot_rows_per_slot=30),
    RiskConfig(hot_account_rows=1, hot_rows_per_slot=7, velocity_window_seconds=60, history_limit=3),
    RiskConfig(hot_account_rows=20, hot_rows_per_slot=50, velocity_window_seconds=7200, history_limit=1),
    RiskConfig(hot_account_rows=20, hot_rows_per_slot=50, broadcast_accounts=0),
])
def test_split_accounts_give_the_same(make, cfg):
    rows = skewed(3)
    assert got(A.account_features(make(rows), cfg)) == brute(rows, cfg)


def test_busy_accounts_are_measured(make):
    tx = make(skewed(4))
    assert A.busy_accounts(tx, RiskConfig()) is None
    assert A.busy_accounts(tx, RiskConfig(hot_account_rows=390)) is None
    busy = A.busy_accounts(tx, RiskConfig(hot_account_rows=100)).collect()
    assert [r.account for r in busy] == ["US0000000001"]
    assert busy[0].n == A.account_rows(tx, "US0000000001").count()


def test_an_instant_is_split_by_id(make):
    """Nearly all rows at one instant: ranges stay even, and results the same."""
    rows = [(n, 1, 2, 5 if n % 50 else n, n % 97) for n in range(600)]
    cfg = RiskConfig(hot_account_rows=50, hot_rows_per_slot=60)
    activity = A.slim_activity(make(rows)).withColumn("account_key", F.xxhash64("account"))
    ranged = A._ranges(activity, ["account_key", "account", "at_us", "id"], 20)
    assert max(r["count"] for r in ranged.groupBy("slot").count().collect()) < 130
    assert got(A.account_features(make(rows), cfg)) == brute(rows, cfg)


def test_many_busy_accounts(make):
    rng = random.Random(15)
    rows = [(n, rng.randint(1, 120), rng.randint(1, 120), rng.randrange(0, 3 * HOUR, 1_000_000), n) for n in range(700)]
    cfg = RiskConfig(hot_account_rows=5, hot_rows_per_slot=40, history_limit=4)
    assert A.busy_accounts(make(rows), cfg).count() > 100
    assert got(A.account_features(make(rows), cfg)) == brute(rows, cfg)


def test_window_is_open_on_the_left_and_counts_the_row_itself(make):
    rows = [(1, 1, 2, 0, 10), (2, 1, 2, HOUR - 1, 10), (3, 1, 2, HOUR, 10), (4, 1, 2, HOUR, 10)]
    assert {n: v for n, (v, _, _) in got(A.account_features(make(rows))).items()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_same_account_on_both_sides_counts_once(make):
    rows = [(1, 1, 1, 0, 10), (2, 1, 1, 5, 20)]
    assert got(A.account_features(make(rows))) == {1: (1, 0, None), 2: (2, 1, Decimal(10))}
    assert A.account_activity(make(rows)).count() == 2


def test_receiving_side_counts_for_the_account(make):
    rows = [(1, 2, 1, 0, 10), (2, 1, 3, 5, 20)]
    assert got(A.account_features(make(rows)))[2] == (2, 1, Decimal(10))


def test_velocity_as_of_bound_is_strict(make):
    tx = make([(1, 1, 2, 0, 10), (2, 1, 3, 1, 10), (3, 1, 1, HOUR, 10)])
    as_of = F.lit("2024-01-01 01:00:00").cast("timestamp")
    counts = {r.account: r.velocity for r in A.velocity_as_of(tx, as_of).collect()}
    assert counts == {"US0000000001": 2, "US0000000003": 1}


def test_recent_transactions_and_history_agree(make):
    tx, cfg = make(skewed(5)), RiskConfig(history_limit=7)
    ranked = A.recent_transactions(tx, cfg).filter("account = 'US0000000001'").orderBy("recency")
    listed = A.account_history(tx, "US0000000001", 7)
    assert [r.id for r in ranked.collect()] == [r.id for r in listed.collect()]


def test_features_from_store(make, spark):
    rows, cfg = skewed(6), RiskConfig(history_limit=5)
    tx = make(rows)
    stored = tx.withColumn("ingest_seq", F.lit(0)).unionByName(
        tx.filter(F.col("amount") > 10000).withColumn("ingest_seq", F.lit(1)))
    late = tx.filter(F.substring("id", 36, 1).isin("1", "4"))
    expected = {n: v for n, v in brute(rows, cfg).items() if n % 10 in (1, 4)}
    assert got(A.features_from_store(late, stored, cfg)) == expected
    small = RiskConfig(history_limit=5, hot_account_rows=10, hot_rows_per_slot=25)
    assert got(A.features_from_store(late, stored, small)) == expected


@pytest.mark.parametrize("span", [1, 5, 90])
def test_features_from_store_by_day(make, span):
    """Rows over some days; the look back ends early or reaches the beginning."""
    rows, cfg = skewed(13, span=span * 24 * HOUR, ties=False), RiskConfig(history_limit=5)
    stored = make(rows).withColumn("ingest_seq", F.lit(0)).withColumn("day", F.to_date("occurred_at"))
    newest = sorted(rows, key=lambda r: r[3])[-5:]
    for some in (newest, [r for r in newest if r[1] == 1] or newest[:1], rows[:3]):
        expected = {n: v for n, v in brute(rows, cfg).items() if n in {r[0] for r in some}}
        assert got(A.features_from_store(make(some), stored, cfg)) == expected


def test_small_ranges_make_no_tasks_of_their_own(make, spark):
    order = ["at_us", "id"]
    activity = A.slim_activity(make(skewed(5)))
    ranged = A._ranges(activity, order, 1 + activity.count() // 4, 4)
    assert len(ranged.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = ranged.groupBy("slot").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("z"))
    found = slots.orderBy("slot").collect()
    assert max(r.n for r in found) == 4 and len(found) < 200
    assert all(r.z <= s.a for r, s in zip(found, found[1:]))
