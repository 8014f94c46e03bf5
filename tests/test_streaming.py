"""Streams against the batch functions, with late, repeated and bad events."""

import cProfile
import json
import pstats
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.operators.activity import account_features
from riskweave.operators.outbox import outbox_cutoff, route_outbox, to_outbox
from riskweave.operators.vectors import embed_transactions
from riskweave.plans import registered
from riskweave.plans.evaluate import evaluate
from riskweave.schemas import DECIDED, EMBEDDINGS, OUTBOX, REJECTS, TRANSACTION_COLUMNS, TRANSACTIONS
from riskweave.sources.streams import read_event_stream, read_outbox_stream
from riskweave.streaming import account_state, run, store

from test_activity import HOUR, skewed

NOW = {"availableNow": True}


def add_events(tx, folder, event_type=V.RECEIVED):
    events = route_outbox(to_outbox(tx, event_type, F.col("occurred_at"))).drop("topic")
    events.coalesce(2).write.mode("append").parquet(f"{folder}/in")


def features(spark, steps, folder, cfg, **state):
    """Velocity and history after feeding the steps one by one."""
    def keep(rows, batch_id):
        rows = rows.persist()
        open_rows.append(rows.filter("velocity is null").count())
        def stored():
            return store.read_all(spark, str(folder), "in", TRANSACTIONS).withColumnRenamed("batch_id", "ingest_seq")

        store.write_batch(account_state.complete_features(rows, stored, cfg), str(folder), "out", batch_id)

    open_rows = []
    for number, step in enumerate(steps):
        store.write_batch(step, str(folder), "in", number)
        rows = spark.readStream.schema(TRANSACTIONS).parquet(f"{folder}/in")
        query = account_state.stream_velocity(rows.select(*TRANSACTION_COLUMNS), cfg, **state)
        query.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(**NOW).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out").drop("batch_id")
    return sorted(map(tuple, out.select(*TRANSACTIONS.names, *account_state.FEATURES).collect())), open_rows


def in_order(make, rows, parts):
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    size = -(-len(rows) // parts)
    return [make(rows[i:i + size]) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("state, opens", [
    ({}, False),
    ({"lateness_seconds": 0}, None),
    ({"max_state_rows": 15}, True),
    ({"max_state_rows": 0}, True),
])
def test_steps_in_time_order_equal_batch(spark, make, tmp_path, state, opens):
    rows, cfg = skewed(7, rows=200, ties=False), RiskConfig(history_limit=5)
    got, open_rows = features(spark, in_order(make, rows, 3), tmp_path, cfg, **state)
    assert got == sorted(map(tuple, account_features(make(rows), cfg).collect()))
    if opens is not None:
        assert any(open_rows) == opens


def test_late_rows_see_everything_before_them(spark, make, tmp_path):
    """The last step holds rows from the very beginning; each sees all rows earlier than it."""
    rows, cfg = skewed(8, rows=200, ties=False), RiskConfig(history_limit=5)
    late = [r for r in rows if r[0] % 10 == 0]
    usual = [r for r in rows if r[0] % 10]
    got, open_rows = features(spark, [*in_order(make, usual, 2), make(late)], tmp_path, cfg, lateness_seconds=0)
    everything = {r.id: tuple(r) for r in account_features(make(rows), cfg).collect()}
    without = {r.id: tuple(r) for r in account_features(make(usual), cfg).collect()}
    late_ids = {f"00000000-0000-0000-0000-{r[0]:012d}" for r in late}
    assert open_rows[-1] > 0
    assert {r[0]: r for r in got} == {i: (everything if i in late_ids else without)[i] for i in everything}


@pytest.mark.parametrize("max_state_rows", [100_000, 5])
def test_state_of_idle_accounts_goes_and_answers_stay(spark, make, tmp_path, max_state_rows):
    """Seven accounts fall silent, two others go on; one comes back with a new row and a row from long ago."""
    day, cfg = 24 * HOUR, RiskConfig(history_limit=5)
    usual = [r for r in skewed(14, rows=120, ties=False)]
    end = max(r[3] for r in usual)
    later = [(1000 + n, 91, 92, end + 20 * day + n * HOUR // 3, 10 + n) for n in range(40)]
    back = [(2000, 1, 2, end + 21 * day, 5), (2001, 1, 92, end - HOUR // 2, 6)]
    steps = [usual, later[:20], later[20:30], [*later[30:], *back]]
    states, progress = [], []

    def keep(rows, batch_id):
        rows = rows.persist()
        def stored():
            return store.read_all(spark, str(tmp_path), "in", TRANSACTIONS).withColumnRenamed("batch_id", "ingest_seq")
        store.write_batch(account_state.complete_features(rows, stored, cfg), str(tmp_path), "out", batch_id)

    for number, step in enumerate(steps):
        store.write_batch(make(step), str(tmp_path), "in", number)
        rows = spark.readStream.schema(TRANSACTIONS).parquet(f"{tmp_path}/in").select(*TRANSACTION_COLUMNS)
        features = account_state.stream_velocity(
            rows, cfg, max_state_rows=max_state_rows, idle_seconds=86_400, check_seconds=0.001)
        with account_state.data_batches_only(spark):
            query = features.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(**NOW).start()
        query.awaitTermination()
        progress.append(len(query.recentProgress))
        states.append(query.lastProgress.stateOperators[0].numRowsTotal)
    accounts = len({a for r in usual for a in r[1:3]})
    # The watermark that shows they are idle is known from the third step on.
    assert states[:3] == [accounts, accounts + 2, 2] and states[3] == 4, progress
    got = {r.id: tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(
        *TRANSACTIONS.names, *account_state.FEATURES).collect()}
    everything = {r.id: tuple(r) for r in account_features(make([r for s in steps for r in s]), cfg).collect()}
    before = {r.id: tuple(r) for r in account_features(make([*usual, *later]), cfg).collect()}
    newest = {f"00000000-0000-0000-0000-{r[0]:012d}" for r in steps[3]}
    assert got == {i: everything[i] if i in newest else before[i] for i in everything}


def test_repeated_events_replace_themselves(spark, make, tmp_path):
    rows, cfg = skewed(9, rows=120, ties=False), RiskConfig(history_limit=5)
    first, second = in_order(make, rows, 2)
    got, _ = features(spark, [first, second.unionByName(second), second], tmp_path, cfg)
    expected = {r.id: tuple(r) for r in account_features(make(rows), cfg).collect()}
    assert {r[0]: r for r in got} == expected and len(got) == 120 + 2 * 60


@pytest.fixture(scope="module")
def loop(spark, make, tmp_path_factory):
    """The whole loop over three steps with bad events and a published decision among them."""
    folder = str(tmp_path_factory.mktemp("loop"))
    rows = [(n, a, b, us, amount * 2) for n, a, b, us, amount in skewed(10, rows=150, ties=False)]
    cfg = RiskConfig(velocity_limit=6)
    bad = spark.createDataFrame(
        [("k1", "not json", V.RECEIVED), ("k2", "{}", V.RECEIVED), ("k3", "{}", "TransactionDeleted"), ("k4", "{}", None)],
        "key string, value string, t string")
    header = F.struct(F.lit("eventType").alias("key"), F.col("t").cast("binary").alias("value"))
    bad = bad.select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        F.when(F.col("t").isNotNull(), F.array(header)).alias("headers"), F.current_timestamp().alias("timestamp"))
    for number, step in enumerate(in_order(make, rows, 3)):
        add_events(step, folder)
        if number == 1:
            bad.write.mode("append").parquet(f"{folder}/in")
            decided = step.limit(2).withColumns({
                "decision": F.lit("BLOCK"), "risk_score": F.lit(Decimal("88.00")).cast("decimal(5,2)"),
                "reasoning": F.lit("seen before"), "evaluated_at": F.col("occurred_at")})
            add_events(decided, folder, V.EVALUATED)
        run.run_stream(spark, read_event_stream(spark, f"{folder}/in", format="parquet"), f"{folder}/store", cfg)
    return folder, make(rows), cfg


def test_stream_decides_like_batch(spark, loop):
    """Batch and stream search the vectors of the transactions before each row, on their own."""
    folder, tx, cfg = loop
    decisions = store.read_all(spark, f"{folder}/store", "decisions", DECIDED)
    assert decisions.count() == 150 and decisions.select("batch_id").distinct().count() == 3
    expected = evaluate(tx, cfg=cfg).select(*DECIDED.names)
    assert sorted(map(tuple, decisions.drop("batch_id").collect())) == sorted(map(tuple, expected.collect()))
    assert decisions.filter("decision <> 'APPROVE'").count() > 10
    assert decisions.filter("reasoning like '%similar-count=4%'").count() > 5


def test_stored_vectors_serve_as_well(spark, loop):
    folder, tx, cfg = loop
    stored = store.read_latest(spark, f"{folder}/store", "embeddings", EMBEDDINGS)
    one = sorted(map(tuple, evaluate(tx, cfg=cfg).select(*DECIDED.names).collect()))
    assert sorted(map(tuple, evaluate(tx, stored, cfg).select(*DECIDED.names).collect())) == one


def test_bad_events_are_kept_apart(spark, loop):
    folder, _, _ = loop
    rejects = {r.key: r.reject_reason for r in spark.read.parquet(f"{folder}/store/rejects").collect()}
    assert rejects == {"k1": "unparseable payload", "k2": "invalid id", "k3": "unknown event type", "k4": "missing event type"}


def test_published_decisions_are_recorded_and_not_computed_again(spark, loop):
    folder, _, _ = loop
    audit = spark.read.parquet(f"{folder}/store/audit").collect()
    assert [(r.decision, r.risk_score, r.reasoning) for r in audit] == [("BLOCK", Decimal("88.00"), "seen before")] * 2


def test_stored_tables_match_the_events(spark, loop):
    folder, tx, _ = loop
    stored = store.read_latest(spark, f"{folder}/store", "transactions", TRANSACTIONS)
    assert sorted(map(tuple, stored.select(*TRANSACTIONS.names).collect())) == sorted(map(tuple, tx.collect()))
    vectors = store.read_latest(spark, f"{folder}/store", "embeddings", EMBEDDINGS)
    same = vectors.join(embed_transactions(tx), ["id", "text", "embedding"], "left_semi")
    assert vectors.count() == same.count() == 150


def test_outbox_is_relayed_once(spark, loop):
    folder, _, _ = loop
    for _ in range(2):
        rows = read_outbox_stream(spark, f"{folder}/store/outbox")
        run.relay_outbox(rows, folder, NOW, path=f"{folder}/topic").awaitTermination()
    sent = spark.read.parquet(f"{folder}/topic")
    assert sent.count() == 150 and sent.select("topic").distinct().first().topic == "outbox.event.Transaction"
    payload = json.loads(bytes(sent.first().value))
    assert set(payload) == {"id", "amount", "currency", "fromAccount", "toAccount", "description", "occurredAt",
                            "decision", "riskScore", "reasoning", "evaluatedAt"}
    frames = read_event_stream(spark, f"{folder}/topic", format="parquet")
    run.start_side_outputs(frames, f"{folder}/back", NOW).awaitTermination()
    assert spark.read.parquet(f"{folder}/back/audit").count() == 150
    assert store.read_all(spark, f"{folder}/back", "rejects", REJECTS).isEmpty()


def test_purge_happens_in_place_and_again_without_harm(spark, loop, tmp_path):
    folder, _, _ = loop
    root = str(tmp_path)
    spark.read.parquet(f"{folder}/store/outbox").write.partitionBy("batch_id", "day").parquet(f"{root}/outbox")
    cutoff = outbox_cutoff(F.lit("2024-01-08 02:30:00").cast("timestamp"))
    old = spark.read.parquet(f"{root}/outbox").filter("created_at < timestamp '2024-01-01 02:30:00'").count()
    assert 0 < old < 150
    assert store.purge_outbox(spark, root, cutoff) == old
    kept = store.read_all(spark, root, "outbox", OUTBOX, by_day=True)
    assert kept.count() == 150 - old and kept.filter("created_at < timestamp '2024-01-01 02:30:00'").isEmpty()
    assert store.purge_outbox(spark, root, cutoff) == 0
    assert store.read_all(spark, root, "outbox", OUTBOX, by_day=True).count() == 150 - old


def test_compacting_leaves_the_last_rows(spark, make, tmp_path):
    root, rows = str(tmp_path), skewed(12, rows=40)
    first, second = make(rows), make([(*r[:4], r[4] + 1) for r in rows[:10]])
    for n, part in enumerate((first, second)):
        store.write_batch(part, root, "transactions", n, day_of="occurred_at")
    before = sorted(map(tuple, store.read_latest(spark, root, "transactions", TRANSACTIONS).collect()))
    store.compact(spark, root, "transactions", TRANSACTIONS, 1, day_of="occurred_at")
    assert sorted(map(tuple, store.read_latest(spark, root, "transactions", TRANSACTIONS).collect())) == before
    assert store.read_all(spark, root, "transactions", TRANSACTIONS, by_day=True).count() == 40


@pytest.mark.parametrize("state", [{"max_state_rows": 0}, {"max_state_rows": 3}, {}, {"lateness_seconds": 0}])
def test_every_delivery_is_answered_as_the_table_stands(spark, make, state):
    """Copies in one delivery, in two, and with another account and amount: the same for any size of the state."""
    rows, cfg = skewed(13, rows=60, ties=False), RiskConfig(history_limit=5)
    rows = sorted(rows, key=lambda r: r[3])
    early, late = rows[:30], rows[30:]
    moved = [(r[0], r[1] % 7 + 1, r[2], r[3], r[4] + 5) for r in early[:6]]
    deliveries = [[*early, *early[:4]], [*late, *moved, early[8]]]
    got = registered.answer_deliveries(spark, [make(d) for d in deliveries], cfg, **state).collect()
    stands, expected = {}, []
    for n, delivery in enumerate(deliveries):
        stands |= {r[0]: r for r in delivery}
        answers = {r.id: r for r in account_features(make(list(stands.values())), cfg).collect()}
        for row in make(delivery).collect():
            a = answers[row.id]
            expected.append((n, row.id, row.from_account, row.amount, a.velocity, a.history_count, a.history_sum))
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def test_a_batch_that_runs_again_leaves_the_same_rows(spark, make, tmp_path):
    tx = make(skewed(11, rows=30))
    outbox = to_outbox(tx, V.RECEIVED, F.col("occurred_at"), F.lit(4))
    for _ in range(2):
        store.write_batch(outbox, str(tmp_path), "outbox", 4, day_of="created_at")
    store.write_batch(outbox.limit(5), str(tmp_path), "outbox", 5, day_of="created_at")
    rows = store.read_all(spark, str(tmp_path), "outbox", OUTBOX)
    assert rows.count() == 35 and rows.filter("batch_id = 4").select("id").distinct().count() == 30
    assert store.read_latest(spark, str(tmp_path), "outbox", OUTBOX).count() == 30


def test_a_step_of_a_small_account_is_cheap(make):
    """Answers of plain rows, and few calls for them: the accounts of a micro-batch are many."""
    rows = [r.asDict() for r in make([(n, 1, 2, n * HOUR, n + 1) for n in range(4)]).collect()]
    frame = pd.DataFrame([{**r, "account": r["from_account"], "is_from": n != 2, "at_us": at}
                          for n, (r, at) in enumerate(zip(rows, (10, 20, 20, None)))])
    frame["occurred_at"] = pd.to_datetime(frame["occurred_at"])
    kept = [(5, "before", Decimal(7))]
    profile = cProfile.Profile()
    answers, line, dropped = profile.runcall(account_state._advance, frame, kept, account_state._NOTHING_DROPPED, 12, 100, 2)
    got = {r.id[-1]: (r.velocity, r.history_count, r.history_sum) for a in answers for r in a.itertuples()}
    # The row that is only received counts, the one without a time is left open.
    assert got == {"0": (2, 1, Decimal(7)), "1": (3, 2, Decimal(8)), "3": (None, None, None)}
    assert [(at, id[-1]) for at, id, _ in line] == [(5, "e"), (10, "0"), (20, "1"), (20, "2")]
    assert dropped == account_state._NOTHING_DROPPED
    assert pstats.Stats(profile).total_calls < 4000


def test_answers_are_not_put_together_by_kind(make):
    """Frames of very few rows: making one block of columns of a kind would cost more than the answers."""
    rows = [r.asDict() for r in make([(n, 1, 2, n * HOUR, n + 1) for n in range(4)]).collect()]
    frame = pd.DataFrame([{**r, "account": r["from_account"], "is_from": True, "at_us": 10 * n} for n, r in enumerate(rows)])
    frame["occurred_at"] = pd.to_datetime(frame["occurred_at"])
    profile = cProfile.Profile()
    answers, _, _ = profile.runcall(account_state._advance, frame, [], account_state._NOTHING_DROPPED, 12, 100, 2)
    assert [r.velocity for a in answers for r in a.itertuples()] == [1, 2, 2, 2]
    assert not any(name == "_consolidate" for _, _, name in pstats.Stats(profile).stats)
