"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.embed import hash_embedding
from riskweave.functions.text import transaction_text
from riskweave.operators import activity, cost, outbox, redact, rules, scoring, tables, validate, vectors
from riskweave.plans import fixtures
from riskweave.plans.evaluate import evaluate, gate, neighbours, score_flagged, similar_to_flagged, stored_vectors
from riskweave.schemas import DECIDED, OUTBOX, TRANSACTION_COLUMNS, TRANSACTIONS
from riskweave.session import configure, cut, releasing, scratch_dir
from riskweave.sources import streams
from riskweave.sources import tables as table_sources
from riskweave.streaming import account_state, run, store

Query = Callable[[SparkSession, str], DataFrame]

# Two transactions in an hour are the limit, so that the test tables reach it.
CFG = RiskConfig.from_settings({"velocity-limit": 2, "velocity-window": "PT1H"})
ACCOUNT = "US0000000042"
TRANSACTION = "00000000-0000-0000-0000-000000000042"

_QUERIES: dict[str, Query] = {}


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _query(make: Query) -> Query:
    """Register a query; instants leave as UTC wall time, whatever zone the reader is in."""

    @wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(configure(spark), sf_dir)
        return df.select([
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema.fields
        ])

    _QUERIES[make.__name__.rstrip("_")] = run
    return make


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(gate(fixtures.transactions(spark, sf_dir), CFG).filter(F.col("gate_decision") == "FLAG"))


def _similar(spark: SparkSession, sf_dir: str, flagged: DataFrame, model=scoring.heuristic) -> DataFrame:
    tx = fixtures.transactions(spark, sf_dir)
    return neighbours(similar_to_flagged(flagged, stored_vectors(tx), CFG), tx, model)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(fixtures.transactions(spark, sf_dir), cfg=CFG)


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = outbox.to_outbox(fixtures.transactions(spark, sf_dir), V.RECEIVED, F.col("occurred_at"))
    evaluated = outbox.to_outbox(_decisions(spark, sf_dir), V.EVALUATED, F.col("evaluated_at"))
    return received.unionByName(evaluated)


def _stored_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox as it is stored, by day."""
    folder = scratch_dir(spark, "stored-outbox")
    store.write_batch(_outbox(spark, sf_dir), folder, "outbox", 0, day_of="created_at")
    return store.read_all(spark, folder, "outbox", OUTBOX, by_day=True)


def _weights(embedded: DataFrame, *columns: str) -> DataFrame:
    """Stored vectors as rows, one per non-zero place."""
    places = embedded.select(*columns, F.posexplode("embedding").alias("bucket", "weight"))
    return places.filter("weight <> 0").select(
        *columns, F.col("bucket").cast("bigint").alias("bucket"), F.col("weight").cast("decimal(9,6)").alias("weight"))


# ---- tables and lookups -----------------------------------------------------

@_query
def read_transactions(spark, sf_dir):
    folder = scratch_dir(spark, "transactions")
    fixtures.transactions(spark, sf_dir).write.parquet(folder)
    return table_sources.read_transactions(spark, folder)


@_query
def transaction_by_id(spark, sf_dir):
    return tables.transaction_by_id(fixtures.transactions(spark, sf_dir), TRANSACTION)


@_query
def transactions_by_ids(spark, sf_dir):
    return tables.transactions_by_ids(fixtures.transactions(spark, sf_dir), fixtures.wanted_ids(spark, sf_dir))


@_query
def newer_than(spark, sf_dir):
    return tables.newer_than(fixtures.transactions(spark, sf_dir), instant("2024-01-15 12:00:00"))


@_query
def upsert_latest(spark, sf_dir):
    return tables.upsert_latest(fixtures.deliveries(spark, sf_dir))


# ---- account activity -------------------------------------------------------

@_query
def account_rows(spark, sf_dir):
    return activity.account_rows(fixtures.transactions(spark, sf_dir), ACCOUNT)


@_query
def account_history(spark, sf_dir):
    return activity.account_history(fixtures.transactions(spark, sf_dir), ACCOUNT, CFG.history_limit)


@_query
def account_activity(spark, sf_dir):
    return activity.account_activity(fixtures.transactions(spark, sf_dir))


@_query
def velocity_as_of(spark, sf_dir):
    return activity.velocity_as_of(fixtures.transactions(spark, sf_dir), instant("2024-01-15 12:00:00"), CFG)


@_query
def velocity(spark, sf_dir):
    return activity.velocity(fixtures.transactions(spark, sf_dir), CFG).select("id", "from_account", "velocity")


@_query
def history_window(spark, sf_dir):
    return activity.history_window(fixtures.transactions(spark, sf_dir), CFG).select(
        "id", "from_account", "history_count", "history_sum", "history_mean")


# So small that every account is split, into many ranges.
SPLIT = RiskConfig(velocity_limit=2, hot_account_rows=1, hot_rows_per_slot=500)


@_query
def velocity_split(spark, sf_dir):
    return activity.velocity(fixtures.transactions(spark, sf_dir), SPLIT).select("id", "from_account", "velocity")


@_query
def history_split(spark, sf_dir):
    return activity.history_window(fixtures.transactions(spark, sf_dir), SPLIT).select(
        "id", "from_account", "history_count", "history_sum", "history_mean")


@_query
def recent_transactions(spark, sf_dir):
    return activity.recent_transactions(fixtures.transactions(spark, sf_dir), CFG).select(
        "account", "id", "amount", "occurred_at", F.col("recency").cast("bigint").alias("recency"))


# ---- text, redaction, vectors -----------------------------------------------

@_query
def transaction_text_(spark, sf_dir):
    return fixtures.transactions(spark, sf_dir).select("id", transaction_text().alias("text"))


@_query
def redact_transactions(spark, sf_dir):
    return redact.redact_transactions(fixtures.transactions(spark, sf_dir))


@_query
def redact_documents(spark, sf_dir):
    return redact.redact_texts(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def embed_transactions(spark, sf_dir):
    return _weights(vectors.embed_transactions(fixtures.transactions(spark, sf_dir)), "id")


@_query
def store_embeddings(spark, sf_dir):
    latest = tables.upsert_latest(fixtures.deliveries(spark, sf_dir))
    stored = vectors.embed_transactions(latest, keep=("ingest_seq",))
    return _weights(stored, "id", "ingest_seq")


@_query
def knn(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    return vectors.knn(rows, rows, CFG.max_neighbours, CFG).withColumn("rank", F.col("rank").cast("bigint"))


@_query
def knn_self_takes_slot(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    matches = vectors.knn(rows, rows, CFG.max_neighbours, CFG, self_takes_slot=True)
    return matches.withColumn("rank", F.col("rank").cast("bigint"))


@_query
def similar_within(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    return vectors.similar_within(rows, rows, 0.6, cfg=CFG).withColumn("rank", F.col("rank").cast("bigint"))


# Cells of more vectors go in several units of work.
BLOCKS = RiskConfig(cut_vectors=100)


@_query
def knn_blocks(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    return vectors.knn(rows, rows, CFG.max_neighbours, BLOCKS).withColumn("rank", F.col("rank").cast("bigint"))


@_query
def similar_blocks(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    return vectors.similar_within(rows, rows, 0.6, cfg=BLOCKS).withColumn("rank", F.col("rank").cast("bigint"))


@_query
def similar_transactions(spark, sf_dir):
    """Neighbours of flagged rows among the transactions before them."""
    tx = fixtures.transactions(spark, sf_dir)
    matches = similar_to_flagged(_flagged(spark, sf_dir), stored_vectors(tx), CFG)
    return matches.withColumn("rank", F.col("rank").cast("bigint"))


@_query
def similar_transactions_embed(spark, sf_dir):
    """The same with another embedder."""
    tx, embed = fixtures.transactions(spark, sf_dir), partial(hash_embedding, dimensions=32)
    matches = similar_to_flagged(_flagged(spark, sf_dir), stored_vectors(tx, embed), CFG, embed)
    return matches.withColumn("rank", F.col("rank").cast("bigint"))


# ---- gate, scores, decisions ------------------------------------------------

@_query
def rule_gate(spark, sf_dir):
    return gate(fixtures.transactions(spark, sf_dir), CFG).select(
        "id", "velocity", "gate_decision", "gate_score", "gate_reason")


@_query
def gate_counts(spark, sf_dir):
    return gate(fixtures.transactions(spark, sf_dir), CFG).groupBy("gate_decision").agg(F.count("*").alias("n"))


@_query
def assess(spark, sf_dir):
    flagged = _flagged(spark, sf_dir)
    rows = flagged.join(_similar(spark, sf_dir, flagged), "id", "left")
    return scoring.assess(rows).select(
        "id", F.coalesce("similar_count", F.lit(0)).alias("similar_count"), "assessment_risk", "assessment_reasoning")


def second_opinion(redacted: dict, similar: list[dict]) -> tuple[float, str]:
    """Some answer from what a model is given; it fails on every ninth id."""
    if int(redacted["id"][24:]) % 9 == 0:
        raise RuntimeError("no answer")
    larger = sum(n["amount"] > redacted["amount"] for n in similar)
    return 100.0 * larger / max(1, len(similar)), f"{larger} of {len(similar)} from {redacted['redacted_from_account']}"


@_query
def assess_with_model(spark, sf_dir):
    flagged = _flagged(spark, sf_dir)
    model = scoring.model_of(second_opinion)
    rows = scoring.assess(flagged.join(_similar(spark, sf_dir, flagged, model), "id", "left"), model)
    return rows.select("id", "assessment_ok", "assessment_risk", "assessment_reasoning")


@_query
def history_risk(spark, sf_dir):
    return scoring.history_risk(_flagged(spark, sf_dir)).select("id", "history_count", "history_risk")


@_query
def score(spark, sf_dir):
    number = F.substring("id", 25, 12).cast("bigint")
    availability = {"assessment_ok": number % 5 != 0, "history_ok": number % 3 != 0, "neighbours_ok": number % 7 != 0}
    flagged = _flagged(spark, sf_dir)
    scored = score_flagged(flagged, _similar(spark, sf_dir, flagged), CFG, availability=availability)
    return scored.select("id", "assessment_ok", "history_ok", "risk_score", "decision", "reasoning")


@_query
def decide(spark, sf_dir):
    gated = gate(fixtures.transactions(spark, sf_dir), CFG)
    return scoring.decide_early(gated).select("id", "decision", "risk_score", "reasoning")


@_query
def evaluate_(spark, sf_dir):
    return _decisions(spark, sf_dir).select("id", "amount", "gate_decision", "decision", "risk_score", "reasoning")


def _damaged(df: DataFrame, id_column: str, column: str, value: Column, every: int) -> DataFrame:
    """Every n-th row by id with a bad value, so that a check has something to find."""
    number = F.substring(id_column, 25, 12).cast("bigint")
    return df.withColumn(column, F.when(number % every == 0, value).otherwise(F.col(column)))


@_query
def assertions(spark, sf_dir):
    """Rows that break a promise of an operator, per promise; some were damaged before."""
    tx, pairs = fixtures.transactions(spark, sf_dir), fixtures.embeddings(spark, sf_dir)
    matches = vectors.knn(pairs, pairs, CFG.max_neighbours, CFG)
    gated, decided = gate(tx, CFG), _decisions(spark, sf_dir)
    checks = {
        "decision": scoring.decision_faults(_damaged(decided, "id", "decision", F.lit("MAYBE"), 40)),
        "score": scoring.decision_faults(_damaged(decided, "id", "risk_score", F.lit("100.01").cast("decimal(5,2)"), 41)),
        "gate": rules.gate_faults(_damaged(gated, "id", "gate_reason", F.lit(None), 42)),
        "redaction": redact.redaction_faults(
            _damaged(redact.redact_transactions(tx), "id", "redacted_to_account", F.lit("0123ABCD"), 43)),
        "similarity": vectors.similarity_faults(_damaged(matches, "query_id", "similarity", F.lit(1.5), 44)),
    }
    counts = [
        df.agg(F.count("*").alias("faults")).select(F.lit(name).alias("promise"), "faults")
        for name, df in checks.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@_query
def audit_log(spark, sf_dir):
    return outbox.audit_log(_decisions(spark, sf_dir))


# ---- events, requests, outbox -----------------------------------------------

@_query
def decode_received(spark, sf_dir):
    return validate.decode_received(fixtures.raw_events(spark, sf_dir))


@_query
def decode_evaluated(spark, sf_dir):
    return validate.decode_evaluated(fixtures.raw_events(spark, sf_dir))


@_query
def route_events(spark, sf_dir):
    return validate.route_events(fixtures.raw_events(spark, sf_dir)).select("event_id", "route")


@_query
def validate_events(spark, sf_dir):
    return validate.validate_events(fixtures.raw_events(spark, sf_dir)).select(
        "event_id", "event_type", *TRANSACTION_COLUMNS, "reject_reason")


@_query
def reject_counts(spark, sf_dir):
    return validate.reject_counts(validate.validate_events(fixtures.raw_events(spark, sf_dir)))


@_query
def validate_requests(spark, sf_dir):
    return validate.validate_requests(fixtures.requests(spark, sf_dir)).select(
        "event_id", F.array_join("reject_reasons", "; ").alias("reject_reasons"))


@_query
def request_to_transaction(spark, sf_dir):
    checked = validate.validate_requests(fixtures.requests(spark, sf_dir))
    valid = checked.filter(F.size("reject_reasons") == 0)
    return validate.request_to_transaction(valid, F.col("event_id"), instant("2024-02-01 00:00:00"))


@_query
def to_outbox(spark, sf_dir):
    return _outbox(spark, sf_dir)


@_query
def route_outbox(spark, sf_dir):
    return outbox.route_outbox(_stored_outbox(spark, sf_dir)).select(
        "topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        validate.event_type_of(F.col("headers")).alias("event_type"))


@_query
def outbox_scores(spark, sf_dir):
    return outbox.outbox_scores(_stored_outbox(spark, sf_dir))


@_query
def outbox_retained(spark, sf_dir):
    kept = outbox.outbox_retained(_stored_outbox(spark, sf_dir), outbox.outbox_cutoff(instant("2024-01-31 00:00:00")))
    return kept.select("id", "event_type", "created_at")


@_query
def outbox_purge_count(spark, sf_dir):
    return outbox.outbox_purge_count(_stored_outbox(spark, sf_dir), outbox.outbox_cutoff(instant("2024-01-31 00:00:00")))


# ---- model cost -------------------------------------------------------------

@_query
def llm_cost(spark, sf_dir):
    return cost.llm_cost(fixtures.usage(spark, sf_dir))


@_query
def llm_cost_dated(spark, sf_dir):
    """With prices from a table, that change with time."""
    return cost.llm_cost(fixtures.dated_usage(spark, sf_dir), fixtures.prices(spark), at="day")


@_query
def llm_cost_by_model(spark, sf_dir):
    return cost.llm_cost_by_model(fixtures.usage(spark, sf_dir))


# ---- streams ----------------------------------------------------------------
# Each query feeds its stream in three steps, older transactions first, and
# runs it until it has caught up after each step.

STEPS = ("2024-01-10", "2024-01-20")


def _steps(rows: DataFrame, column: str):
    """Rows before the first bound, between bounds, and from the last bound on."""
    at = F.col(column)
    for start, end in zip((None, *STEPS), (*STEPS, None)):
        after = F.lit(True) if start is None else at >= instant(start)
        yield rows.filter(after if end is None else after & (at < instant(end)))


def _received_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = outbox.to_outbox(fixtures.transactions(spark, sf_dir), V.RECEIVED, F.col("occurred_at"))
    return outbox.route_outbox(received).drop("topic")


def _caught_up(writer, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@_query
def read_event_stream(spark, sf_dir):
    folder = scratch_dir(spark, "events")
    for step in _steps(_received_records(spark, sf_dir), "timestamp"):
        step.write.mode("append").parquet(f"{folder}/in")
        frames = streams.read_event_stream(spark, f"{folder}/in", format="parquet")
        _caught_up(frames.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out")


@_query
def read_outbox_stream(spark, sf_dir):
    folder = scratch_dir(spark, "outbox")
    received = outbox.to_outbox(fixtures.transactions(spark, sf_dir), V.RECEIVED, F.col("occurred_at"))
    for step in _steps(received, "created_at"):
        step.write.mode("append").parquet(f"{folder}/in")
        rows = streams.read_outbox_stream(spark, f"{folder}/in")
        _caught_up(rows.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out")


def _relayed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = scratch_dir(spark, "relay")
    for step in _steps(rows, "created_at"):
        step.write.mode("append").parquet(f"{folder}/in")
        rows = streams.read_outbox_stream(spark, f"{folder}/in")
        run.relay_outbox(rows, folder, {"availableNow": True}, path=f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        validate.event_type_of(F.col("headers")).alias("event_type"))


@_query
def relay_outbox(spark, sf_dir):
    return _relayed(spark, outbox.to_outbox(fixtures.transactions(spark, sf_dir), V.RECEIVED, F.col("occurred_at")))


@_query
def relay_outbox_both(spark, sf_dir):
    """Received and evaluated events through one relay."""
    return _relayed(spark, cut(_outbox(spark, sf_dir)))


def _stream_velocity(spark: SparkSession, sf_dir: str, **state) -> DataFrame:
    folder = scratch_dir(spark, "velocity")

    def keep(rows: DataFrame, batch_id: int) -> None:
        def stored() -> DataFrame:
            return spark.read.schema(TRANSACTIONS).parquet(f"{folder}/in").withColumn("ingest_seq", F.lit(0))

        with releasing():
            store.write_batch(account_state.complete_features(cut(rows), stored, CFG), folder, "out", batch_id)

    for step in _steps(fixtures.transactions(spark, sf_dir), "occurred_at"):
        step.write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(TRANSACTIONS).parquet(f"{folder}/in")
        with account_state.data_batches_only(spark):
            _caught_up(account_state.stream_velocity(rows, CFG, **state).writeStream.foreachBatch(keep), folder)
    return spark.read.parquet(f"{folder}/out").select(
        "id", "from_account", "velocity", "history_count", "history_sum")


@_query
def stream_velocity(spark, sf_dir):
    return _stream_velocity(spark, sf_dir)


@_query
def stream_velocity_open(spark, sf_dir):
    """With so little state that most rows are answered from the store."""
    return _stream_velocity(spark, sf_dir, lateness_seconds=0, max_state_rows=30)


@_query
def stream_velocity_expiring(spark, sf_dir):
    """With state that goes when an account is idle for a day; accounts that come back are answered from the store."""
    return _stream_velocity(spark, sf_dir, idle_seconds=86_400, check_seconds=0.001)


def redeliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three deliveries: with copies inside one, copies of earlier rows, and earlier rows with another account and amount."""
    first, second, third = _steps(fixtures.transactions(spark, sf_dir), "occurred_at")
    number = F.substring("id", 25, 12).cast("bigint")
    moved = first.filter(number % 21 == 0).withColumns({
        "amount": (F.col("amount") + 1000).cast("decimal(19,4)"),
        "from_account": F.concat(F.lit("US"), F.lpad((number % 150).cast("string"), 10, "0"))})
    return [
        first.unionByName(first.filter(number % 10 == 0)),
        second.unionByName(first.filter(number % 15 == 0)),
        third.unionByName(moved),
    ]


def answer_deliveries(spark: SparkSession, deliveries: list[DataFrame], cfg: RiskConfig = CFG, **state) -> DataFrame:
    """Features of every delivered row, as the table stood after its delivery."""
    folder = scratch_dir(spark, "deliveries")

    def keep(rows: DataFrame, batch_id: int) -> None:
        with releasing():
            rows = cut(rows)
            standing, reopened = store.save_batch(spark, rows, folder, batch_id)
            store.write_batch(account_state.complete_features(rows, standing, cfg, reopened), folder, "out", batch_id)

    for step in deliveries:
        step.write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(TRANSACTIONS).parquet(f"{folder}/in")
        _caught_up(account_state.stream_velocity(rows, cfg, **state).writeStream.foreachBatch(keep), folder)
    return spark.read.parquet(f"{folder}/out").select(
        F.col("batch_id").cast("bigint").alias("delivery"), "id", "from_account", "amount", "velocity", "history_count", "history_sum")


@_query
def redelivery(spark, sf_dir):
    return answer_deliveries(spark, redeliveries(spark, sf_dir))


@_query
def purge_outbox(spark, sf_dir):
    folder = scratch_dir(spark, "purge")
    rows = outbox.to_outbox(fixtures.transactions(spark, sf_dir), V.RECEIVED, F.col("occurred_at"))
    for batch_id, step in enumerate(_steps(rows, "created_at")):
        store.write_batch(step, folder, "outbox", batch_id, day_of="created_at")
    store.purge_outbox(spark, folder, outbox.outbox_cutoff(instant("2024-01-24 07:30:00")))
    return store.read_all(spark, folder, "outbox", OUTBOX, by_day=True).select(*OUTBOX.names)


@_query
def compact_store(spark, sf_dir):
    """Deliveries in two batches, made one."""
    folder = scratch_dir(spark, "compact")
    rows = fixtures.deliveries(spark, sf_dir)
    late = F.col("ingest_seq") >= 1_000_000_000
    for batch_id, part in enumerate((rows.filter(~late), rows.filter(late))):
        store.write_batch(part.select(*TRANSACTIONS.names), folder, "transactions", batch_id, day_of="occurred_at")
    store.compact(spark, folder, "transactions", TRANSACTIONS, 1, day_of="occurred_at")
    return store.read_all(spark, folder, "transactions", TRANSACTIONS, by_day=True).drop("day")


def _run_loop(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_dir(spark, "loop")
    for step in _steps(_received_records(spark, sf_dir), "timestamp"):
        step.write.mode("append").parquet(f"{folder}/in")
        frames = streams.read_event_stream(spark, f"{folder}/in", format="parquet")
        run.run_stream(spark, frames, f"{folder}/store", CFG)
    return f"{folder}/store"


@_query
def run_stream(spark, sf_dir):
    return store.read_latest(spark, _run_loop(spark, sf_dir), "decisions", DECIDED)


def _side_outputs(spark: SparkSession, sf_dir: str) -> str:
    """Rejected events and recorded decisions of a stream of events with every fault."""
    folder = scratch_dir(spark, "side-outputs")
    raw = fixtures.raw_events(spark, sf_dir)
    header = F.struct(F.lit(V.EVENT_TYPE_HEADER).alias("key"), F.col("event_type").cast("binary").alias("value"))
    raw.select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
        F.when(F.col("event_type").isNotNull(), F.array(header)).alias("headers"),
        instant("2024-02-01 00:00:00").alias("timestamp"),
    ).write.parquet(f"{folder}/in")
    frames = streams.read_event_stream(spark, f"{folder}/in", format="parquet")
    run.start_side_outputs(frames, folder, {"availableNow": True}).awaitTermination()
    return folder


@_query
def reject_stream(spark, sf_dir):
    rejects = spark.read.parquet(f"{_side_outputs(spark, sf_dir)}/rejects")
    return rejects.select(F.col("key").cast("bigint").alias("event_id"), "event_type", "value", "reject_reason")


@_query
def audit_stream(spark, sf_dir):
    return spark.read.parquet(f"{_side_outputs(spark, sf_dir)}/audit").drop("batch_id")
