"""Velocity and history inside a stream, kept as state per account.

The state of an account holds the rows a coming transaction may need: those
inside the window plus the allowed lateness, and the N rows before them. A
micro-batch then costs as much as its own rows, however long the history is.

State answers most rows, the stored table the rest. A row is left open (its
features stay null) when it is older than what is kept, or when its account
has outgrown `max_state_rows` and is no longer kept at all;
`complete_features` answers open rows from the store. So both are exact, every
delivered row is answered, and one task never holds more than a bounded number
of rows of one account. A row that comes again replaces itself; if it changed,
its accounts are answered from the store from then on (`store.save_batch`).

With `idle_seconds` the state of an account goes once the watermark is that far
past its last row, outgrown or not. An account without state may then be one
that came back: all its earlier rows are older than the watermark less the idle
time, so its state begins there, and what it cannot know yet is left open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave.config import RiskConfig
from riskweave.operators.activity import FEATURES, features_from_store, slim_activity
from riskweave.schemas import ACCOUNT_FEATURES

STATE = T.StructType([
    T.StructField("at_us", T.ArrayType(T.LongType())),
    T.StructField("ids", T.ArrayType(T.StringType())),
    T.StructField("amounts", T.ArrayType(T.StringType())),
    T.StructField("dropped_us", T.LongType()),
    T.StructField("outgrown", T.BooleanType()),
])
_NOTHING_DROPPED = -(2 ** 62)


def _open(rows: pd.DataFrame) -> pd.DataFrame:
    """Paying rows whose features the store must answer."""
    return rows[rows["is_from"]].assign(velocity=None, history_count=None, history_sum=None)[ACCOUNT_FEATURES.names]


def _advance(new: pd.DataFrame, kept: list[tuple], dropped_us: int, window_us: int, keep_us: int, limit: int):
    """Answers for the new paying rows; the rows to keep; the time of the last row not kept.

    `kept` has (at_us, id, amount), in order of time and id, and is complete
    after `dropped_us`. A row's window must start there or later, and N kept
    rows must precede it, or nothing was ever dropped. Of copies of a row the
    latest, then largest stands; every copy is answered as that one. Accounts
    are many and their rows few: plain lists cost far less here than frames.
    """
    stands: dict = {}
    for at, id, amount in zip(new["at_us"].tolist(), new["id"].tolist(), new["amount"].tolist()):
        # A row without a time stands, and is late.
        row = (at is None or at != at, at, amount is None, amount)
        if id not in stands or row >= stands[id]:
            stands[id] = row
    fresh = [(int(at), id, amount) for id, (timeless, at, _, amount) in stands.items() if not timeless and at > dropped_us]
    line = [row for row in kept if row[1] not in stands] + fresh
    line.sort(key=lambda row: (row[0], row[1] is None, row[1]))
    times = [row[0] for row in line]
    totals = list(accumulate((row[2] for row in line), initial=Decimal(0)))
    place_of = {row[1]: place for place, row in enumerate(line)}
    in_time = {row[1] for row in fresh}

    paying = new["is_from"].to_numpy(bool)
    found = []
    for id in new["id"].array[paying]:
        place = place_of[id] if id in in_time else -1
        at = times[place] if place >= 0 else 0
        if place < 0 or dropped_us != _NOTHING_DROPPED and (at - window_us < dropped_us or place < limit):
            found.append((None, None, None))
            continue
        first = max(place - limit, 0)
        found.append((bisect_right(times, at) - bisect_right(times, at - window_us), place - first,
                      totals[place] - totals[first] if place > first else None))
    answers = []
    if found:
        rows = {c: new[c].array[paying] for c in ACCOUNT_FEATURES.names if c not in FEATURES}
        features = {c: np.array(values, dtype=object) for c, values in zip(FEATURES, zip(*found, strict=True), strict=True)}
        # Copied, columns would be put together by kind: more work than all else here.
        answers.append(pd.DataFrame(rows | features, copy=False))

    start = 0
    if times:
        start = max(0, bisect_right(times, times[-1] - keep_us) - limit)
        # Rows at one instant are kept or dropped together.
        start = bisect_left(times, times[start])
    if start > 0:
        dropped_us = times[start - 1]
    return answers, line[start:], dropped_us


def stream_velocity(
    transactions: DataFrame,
    cfg: RiskConfig = RiskConfig(),
    lateness_seconds: int = 3600,
    max_state_rows: int = 100_000,
    idle_seconds: int | None = None,
    check_seconds: float = 600,
) -> DataFrame:
    """The streaming form of `account_features`; open rows have null features.

    With `idle_seconds`, each account is looked at `check_seconds` after its
    last micro-batch, and again until it is idle. Such a stream is started
    inside `data_batches_only`: Spark would otherwise run empty micro-batches
    without end. Late rows are answered as without it.
    """
    window_us = cfg.velocity_window_us
    keep_us = window_us + lateness_seconds * 1_000_000
    check_ms = max(1, round(check_seconds * 1000))
    limit = cfg.history_limit

    def idle_before(state: GroupState) -> int:
        """Accounts whose last row is not after this time have no state."""
        watermark_ms = state.getCurrentWatermarkMs() if idle_seconds is not None else 0
        return watermark_ms * 1000 - idle_seconds * 1_000_000 if watermark_ms > 0 else _NOTHING_DROPPED

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at_us, ids, amounts, dropped_us, outgrown = (
            state.get if state.exists else ([], [], [], idle_before(state), False))
        if state.hasTimedOut:
            if max([dropped_us, *at_us[-1:]]) <= idle_before(state):
                state.remove()
            else:
                state.setTimeoutDuration(check_ms)
            return
        if idle_seconds is not None:
            state.setTimeoutDuration(check_ms)
        held = []
        for chunk in chunks:
            held.append(chunk)
            outgrown = outgrown or len(at_us) + sum(map(len, held)) > max_state_rows
            if outgrown:
                dropped_us = max([dropped_us, *at_us[-1:], *(int(h["at_us"].max()) for h in held if len(h))])
                yield from filter(len, map(_open, held))
                held = []
        if outgrown:
            state.update(([], [], [], dropped_us, True))
            return
        kept = [(at, id, Decimal(amount)) for at, id, amount in zip(at_us, ids, amounts, strict=True)]
        new = held[0] if len(held) == 1 else pd.concat(held)
        answers, kept, dropped_us = _advance(new, kept, dropped_us, window_us, keep_us, limit)
        state.update(([row[0] for row in kept], [row[1] for row in kept], [str(row[2]) for row in kept], dropped_us, False))
        yield from answers

    rows, timeout = slim_activity(transactions), GroupStateTimeout.NoTimeout
    if idle_seconds is not None:
        # A timeout by event time would drop late rows; this one reads the watermark and drops none.
        timeout = GroupStateTimeout.ProcessingTimeTimeout
        rows = rows.withColumn("event_at", F.expr("timestamp_micros(at_us)")).withWatermark(
            "event_at", f"{lateness_seconds} seconds")
    return rows.groupBy("account").applyInPandasWithState(step, ACCOUNT_FEATURES, STATE, "append", timeout)


@contextmanager
def data_batches_only(spark: SparkSession):
    """Streams started in this block run a micro-batch for data only; a stream keeps the setting it started with."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def complete_features(
    rows: DataFrame, stored: Callable[[], DataFrame], cfg: RiskConfig = RiskConfig(), reopened: DataFrame | None = None
) -> DataFrame:
    """Rows of `stream_velocity` with open features answered from the stored table.

    `stored` opens that table, which has `ingest_seq`; it is only called if a
    row is open. `reopened` lists accounts whose state still holds a row that
    was replaced: their rows count as open.
    """
    is_open = F.col("velocity").isNull()
    if reopened is not None:
        marked = reopened.select(F.col("account").alias("from_account"), F.lit(True).alias("_again")).distinct()
        rows = rows.join(marked, "from_account", "left")
        is_open = is_open | F.col("_again").isNotNull()
    missing = rows.filter(is_open).drop(*FEATURES, "_again")
    if missing.isEmpty():
        return rows.drop("_again")
    answered = rows.filter(~is_open).drop("_again")
    return answered.unionByName(features_from_store(missing, stored(), cfg))
