"""Per-account activity: velocity, history, recent transactions.

A transaction belongs to both its accounts, and once to an account that is
both. `account_activity` turns that OR into one equi key, so everything here
shuffles once on the account.

Busy accounts. Both measures look back along an account's time line, which
would put one account into one task. The rows of accounts above a limit are
therefore sorted by account, time and id in ranges of about equal size,
whatever the accounts and instants are (`_split`):

* velocity depends only on the account and the instant, so it is a running
  count over instants, which needs of earlier ranges only their sum;
* the last N rows before a row lie in its own range, except for the first N
  rows of each account in a range; those are answered from the first and last
  N rows of the account's ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.session import cut

FEATURES = ("velocity", "history_count", "history_sum")
_SUM_TYPE = "decimal(29,4)"


def account_activity(transactions: DataFrame) -> DataFrame:
    """One row per account and transaction; `is_from` marks the paying side.

    The input is read once: each row is expanded in place, not united with a
    second scan.
    """
    return transactions.selectExpr(
        "*", "explode(if(from_account = to_account, array(from_account), array(from_account, to_account))) as account"
    ).selectExpr("*", "account = from_account as is_from")


def account_rows(transactions: DataFrame, account: str) -> DataFrame:
    """Transactions with the account on either side."""
    return transactions.filter((F.col("from_account") == account) | (F.col("to_account") == account))


def account_history(transactions: DataFrame, account: str, limit: int) -> DataFrame:
    """The newest `limit` transactions of one account."""
    return account_rows(transactions, account).orderBy(F.desc("occurred_at"), "id").limit(limit)


def velocity_as_of(transactions: DataFrame, as_of: Column, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Count per account of the rows newer than `as_of` minus the window."""
    since = as_of - F.make_interval(secs=F.lit(cfg.velocity_window_seconds))
    recent = transactions.filter(F.col("occurred_at") > since).select("from_account", "to_account")
    return account_activity(recent).groupBy("account").agg(F.count("*").alias("velocity"))


def recent_transactions(transactions: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """The newest N transactions of every account, ranked.

    The rank filter is applied before the shuffle as well (window group
    limit), so a busy account sends at most N rows per task.
    """
    newest = Window.partitionBy("account").orderBy(F.desc("occurred_at"), "id")
    return (
        account_activity(transactions)
        .withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= cfg.history_limit)
    )


def busy_accounts(transactions: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame | None:
    """`account, n` of the accounts with more than `cfg.hot_account_rows` rows, None if there are none.

    Only the plan depends on this, never a result: every row is evaluated
    either way.
    """
    return _busy(transactions.select("from_account", "to_account"), account_activity, cfg)


def _busy(rows: DataFrame, activity: Callable[[DataFrame], DataFrame], cfg: RiskConfig) -> DataFrame | None:
    if 2 * rows.count() <= cfg.hot_account_rows:
        return None
    counts = activity(rows).groupBy("account").agg(F.count("*").alias("n"))
    busy = cut(counts.filter(F.col("n") > cfg.hot_account_rows))
    return None if busy.isEmpty() else busy


def account_features(
    transactions: DataFrame, cfg: RiskConfig = RiskConfig(), busy: DataFrame | None = None
) -> DataFrame:
    """Every transaction with the velocity and the history of its paying account.

    Adds `velocity` (rows of the account in the window that ends with this
    row, itself included), `history_count` and `history_sum` (the N rows
    before it). `busy` lists the accounts to split (`account, n`); None
    measures them.
    """
    if busy is None:
        busy = busy_accounts(transactions, cfg)
    return activity_features(slim_activity(transactions), cfg, busy).select(*transactions.columns, *FEATURES)


def activity_features(activity: DataFrame, cfg: RiskConfig, busy: DataFrame | None) -> DataFrame:
    """The paying rows of `slim_activity` rows with their features."""
    # Sorting compares the number first, which tells accounts apart faster than their names.
    keys = ["account_key", "account"]
    activity = activity.withColumn("account_key", F.xxhash64("account"))
    if busy is None:
        return _features(activity, keys, cfg).filter("is_from")
    found = busy.agg(F.count("*").alias("accounts"), F.sum("n").alias("n")).first()
    ranges = 1 + found.n // cfg.hot_rows_per_slot
    if found.accounts > cfg.broadcast_accounts:
        # Too many names to send to every task: all accounts are split.
        return _split(activity, keys, cfg, 1 + activity.count() // cfg.hot_rows_per_slot).filter("is_from")
    names = F.broadcast(busy.select("account"))
    usual = activity.join(names, "account", "left_anti")
    split = activity.join(names, "account", "left_semi")
    return _features(usual, keys, cfg).unionByName(_split(split, keys, cfg, ranges)).filter("is_from")


def features_from_store(rows: DataFrame, stored: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Features of some transactions, looked up among all stored ones.

    `rows` are transactions; `stored` is the table that includes them, with
    `ingest_seq` and, if it is partitioned so, `day`. Only accounts that pay
    in `rows` are read back, and of each only what its earliest row can see:
    everything since one window before it, and the N rows before that.

    With `day`, a short look back comes first: it is enough for accounts that
    have their N rows in it, and busy accounts have them soon. Only the others
    look back further.
    """
    paying = cut(rows.groupBy(F.col("from_account").alias("account")).agg(
        (F.min(F.unix_micros("occurred_at")) - cfg.velocity_window_us).alias("since_us")))
    contexts = []
    for days in (1, 30) if "day" in stored.columns else ():
        since_us = paying.agg(F.min("since_us")).first()[0]
        first_day = F.to_date(F.timestamp_micros(F.lit(since_us))) - days
        context, older = _context(paying, stored.filter(F.col("day") >= first_day), cfg)
        complete = cut(older.groupBy("account").count().filter(F.col("count") >= cfg.history_limit).select("account"))
        contexts.append(context.join(complete, "account", "left_semi"))
        paying = cut(paying.join(complete, "account", "left_anti"))
        if paying.isEmpty():
            break
    else:
        contexts.append(_context(paying, stored, cfg)[0])
    context = cut(reduce(DataFrame.unionByName, contexts))
    features = activity_features(context, cfg, _busy(context, lambda rows: rows, cfg))
    return rows.join(features.select("id", *FEATURES), "id")


def _context(paying: DataFrame, stored: DataFrame, cfg: RiskConfig) -> tuple[DataFrame, DataFrame]:
    """Activity of the paying accounts that their rows can see, and the part before the window.

    A repeated row keeps its accounts and time, so copies are dropped after
    the other filters: they share a dense rank, and the limit counts rows.
    """
    seen = (
        account_activity(stored)
        .selectExpr("account", "is_from", "id", "amount", "ingest_seq", "unix_micros(occurred_at) as at_us")
        .join(paying, "account")
    )
    newest = "row_number() over (partition by account, at_us, id order by ingest_seq desc)"
    recency = "dense_rank() over (partition by account order by at_us desc, id desc)"
    near = seen.filter("at_us > since_us").withColumn("_r", F.expr(newest)).filter("_r = 1")
    older = (
        seen.filter("at_us <= since_us")
        .withColumn("_r", F.expr(recency)).filter(F.col("_r") <= cfg.history_limit)
        .withColumn("_r", F.expr(newest)).filter("_r = 1")
    )
    return near.unionByName(older).drop("_r", "since_us", "ingest_seq"), older


def velocity(transactions: DataFrame, cfg: RiskConfig = RiskConfig(), busy: DataFrame | None = None) -> DataFrame:
    return account_features(transactions, cfg, busy).drop("history_count", "history_sum")


def history_window(
    transactions: DataFrame, cfg: RiskConfig = RiskConfig(), busy: DataFrame | None = None
) -> DataFrame:
    """Every transaction with size, sum and mean of the N rows before it."""
    return account_features(transactions, cfg, busy).drop("velocity").withColumn("history_mean", history_mean())


def history_mean() -> Column:
    """Mean of the history amounts as a double; null without history."""
    return F.col("history_sum").cast("double") / F.nullif(F.col("history_count"), F.lit(0))


def slim_activity(transactions: DataFrame) -> DataFrame:
    """`account_activity` whose receiving side carries only what the windows read."""
    payload = [c for c in transactions.columns if c not in ("id", "amount")]
    return account_activity(transactions).selectExpr(
        "account", "is_from", "id", "amount", "unix_micros(occurred_at) as at_us",
        *[f"if(is_from, {c}, null) as {c}" for c in payload],
    )


def _line(keys: Sequence[str]) -> str:
    return f"partition by {', '.join(keys)} order by at_us, id"


def _look_back(activity: DataFrame, keys: Sequence[str], cfg: RiskConfig) -> DataFrame:
    """History of each row, and where the runs of close rows begin.

    The last N rows are a difference of running sums. `_start` begins a new
    run after a gap as long as the window; `_follows` tells whether a row has
    a successor in its run. All of it reads one sort in two passes.
    """
    line, n, window = _line(keys), cfg.history_limit, cfg.velocity_window_us
    running = f"{line} rows between unbounded preceding and current row"
    return (
        activity
        .selectExpr(
            "*",
            f"row_number() over ({line}) as _row",
            f"sum(amount) over ({running}) as _total",
            f"lag(at_us) over ({line}) as _previous",
            f"lead(at_us) over ({line}) as _next",
        )
        .selectExpr(
            "*",
            f"lag(_total, 1) over ({line}) as _until",
            f"lag(_total, {n + 1}) over ({line}) as _before",
            f"max(if(coalesce(at_us - _previous, {window}) >= {window}, at_us, null)) over ({running}) as _start",
        )
        .selectExpr(
            *activity.columns, "_start",
            f"coalesce(_next - at_us, {window}) < {window} as _follows",
            f"cast(least(_row - 1, {n}) as bigint) as history_count",
            f"cast(_until - coalesce(_before, 0) as {_SUM_TYPE}) as history_sum",
        )
    )


def _count(keys: Sequence[str]) -> str:
    """Marks up to and including this instant: equal times count together."""
    return (f"sum(step) over (partition by {', '.join(keys)} order by at_us "
            "range between unbounded preceding and current row)")


def _features(activity: DataFrame, keys: Sequence[str], cfg: RiskConfig) -> DataFrame:
    """Both features with every account whole.

    Velocity is a running count: each row enters at its time and leaves one
    window later, unless its run ends before. Marks are expanded in place, so
    the count needs no shuffle of its own; a mark that leaves carries nothing.
    """
    carried = [c for c in activity.columns if c not in (*keys, "at_us")] + ["history_count", "history_sum"]
    return (
        _look_back(activity, keys, cfg)
        .selectExpr("*", "explode(if(_follows, array(1, -1), array(1))) as step")
        .selectExpr(
            *keys, "_start", "step",
            f"if(step < 0, at_us + {cfg.velocity_window_us}, at_us) as at_us",
            *[f"if(step > 0, {c}, null) as {c}" for c in carried],
        )
        .selectExpr("*", f"{_count([*keys, '_start'])} as velocity")
        .filter("step > 0").drop("step", "_start")
    )


# ---- accounts that are split ------------------------------------------------

#: Fewer rows are not worth a task of their own; ranges may be finer.
ROWS_PER_TASK = 100_000
_PLACE_BITS = 33


def _ranges(rows: DataFrame, order: list[str], n: int, size: int = 1 << _PLACE_BITS) -> DataFrame:
    """Rows with the number of the range they are in; ranges have about equal size and follow the order.

    With `size`, n ranges of so many rows: a task sorts its rows and cuts them,
    so that small ranges make neither as many tasks nor as many files and blocks.
    """
    tasks = min(n, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * size / ROWS_PER_TASK)))
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The task's number in the upper bits, the row's place in the lower.
    at = F.monotonically_increasing_id()
    place = at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return cut(dealt.withColumn("slot", at - place + F.floor(place / size)))


def _split(activity: DataFrame, keys: list[str], cfg: RiskConfig, ranges: int) -> DataFrame:
    """Both features over ranges of rows. No task holds an account, or an instant, as a whole."""
    slot_keys = [*keys, "slot"]
    rows = _ranges(activity, [*keys, "at_us", "id"], ranges, cfg.hot_rows_per_slot)
    velocity = (
        rows.groupBy(*slot_keys, "at_us").count().drop("count")
        .join(_velocity_at(rows, keys, cfg, ranges), [*keys, "at_us"])
    )
    return (
        _look_back(rows, slot_keys, cfg).drop("_start", "_follows")
        .join(_across_slots(rows, keys, cfg), slot_keys, "left")
        .withColumn("_first", F.expr("try_element_at(_across, id)")).drop("_across")
        .withColumns({
            "history_sum": F.when(F.col("_first").isNull(), F.col("history_sum")).otherwise(F.col("_first.sum")),
            "history_count": F.coalesce("_first.count", "history_count"),
        })
        .join(velocity, [*slot_keys, "at_us"])
        .drop("slot", "_first")
    )


def _velocity_at(rows: DataFrame, keys: list[str], cfg: RiskConfig, ranges: int) -> DataFrame:
    """Velocity of every account at each of its instants.

    The rows of an instant enter together and leave one window later. The
    marks are summed before they are shuffled, sorted into ranges, and counted
    up inside each range from the sum of the ranges before it.
    """
    step = F.explode(F.array(
        F.struct(F.col("at_us"), F.col("count").alias("net"), F.lit(True).alias("enters")),
        F.struct((F.col("at_us") + cfg.velocity_window_us).alias("at_us"), (-F.col("count")).alias("net"),
                 F.lit(False).alias("enters"))))
    marks = (
        rows.groupBy(*keys, "at_us").count().select(*keys, step.alias("m")).select(*keys, "m.*")
        .groupBy(*keys, "at_us").agg(F.sum("net").alias("net"), F.max("enters").alias("enters"))
    )
    marks = _ranges(marks, [*keys, "at_us"], ranges, cfg.hot_rows_per_slot)
    earlier = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = marks.groupBy(*keys, "slot").agg(F.sum("net").alias("_net")).withColumn(
        "_base", F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "slot").orderBy("at_us").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.withColumn("_inside", F.sum("net").over(inside))
        .join(base.drop("_net"), [*keys, "slot"])
        .filter("enters")
        .select(*keys, "at_us", (F.col("_inside") + F.col("_base")).alias("velocity"))
    )


def _across_slots(entering: DataFrame, keys: list[str], cfg: RiskConfig) -> DataFrame:
    """Per slot, the history of its first N rows as a map from id.

    It follows from the first and last N rows of all of the account's slots:
    the N rows before such a row are among these, and next to each other. An
    account has at most 2N of them per slot, a map at most N entries.
    """
    n, slot_keys = cfg.history_limit, [*keys, "slot"]
    line = _line(slot_keys)
    edges = (
        entering.selectExpr(
            *slot_keys, "at_us", "id", "amount",
            f"row_number() over ({line}) as _rank", f"lead(id, {n}) over ({line}) as _ahead",
        )
        .filter(f"_rank <= {n} or _ahead is null").drop("_ahead")
    )
    return _look_back(edges, keys, cfg).filter(f"_rank <= {n}").groupBy(*slot_keys).agg(
        F.expr("map_from_entries(collect_list(struct(id, struct(history_count as count, history_sum as sum))))")
        .alias("_across"))
