"""Assessment, history score, weighted score and decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import partial
from inspect import signature

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.text import as_text, fill
from riskweave.operators.activity import history_mean
from riskweave.operators.calls import Breaker, BreakerSettings, call_all
from riskweave.operators.redact import redacted_struct
from riskweave.schemas import SCORE

Model = Callable[..., Column]
_ANSWER = "risk double, reasoning string"


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0).cast("decimal(20,2)"), F.least(F.lit(V.MAX_SCORE).cast("decimal(20,2)"), score))


def amount_points(amount: Column) -> Column:
    """One point per 200 units, two places, at most 100."""
    points = F.round(amount.cast("decimal(20,4)") * F.lit(Decimal(1) / V.AMOUNT_PER_POINT), 2).cast("decimal(20,2)")
    return F.least(F.lit(V.MAX_SCORE).cast("decimal(20,2)"), points)


def similarity_points(count: Column, mean: Column) -> Column:
    """Ten points without neighbours, otherwise minus twenty times the mean similarity."""
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(V.NO_NEIGHBOUR_POINTS)).otherwise(
        F.round(F.lit(V.SIMILARITY_POINTS) * mean, 2).cast("string")
    ).cast("decimal(20,2)")


def heuristic(redacted: Column, similar_count: Column, similar_mean: Column) -> Column:
    """The built-in assessment as `struct<risk, reasoning>`."""
    amount = amount_points(redacted["amount"])
    similar = similarity_points(similar_count, similar_mean)
    return F.struct(
        _clamp(amount + similar).cast(SCORE).alias("risk"),
        fill(
            V.HEURISTIC_REASONING,
            amount=as_text(F.round(amount, 1), 1),
            similarity=as_text(F.round(similar, 1), 1),
            count=F.coalesce(similar_count, F.lit(0)),
        ).alias("reasoning"),
    )


def reads_neighbours(model: Model) -> bool:
    """Whether a model takes the neighbours themselves as a fourth argument."""
    return len(signature(model).parameters) == 4


def model_of(
    analyze: Callable[[dict, list[dict]], tuple[float, str]],
    timeout_seconds: float | None = None,
    width: int = 1,
    breaker: BreakerSettings | None = None,
) -> Model:
    """A model from a function of a redacted transaction and its neighbours, both as dictionaries.

    It runs on Arrow batches, `width` calls at a time in each task. A call that
    raises or takes too long has no answer; the row is then scored without an
    assessment. With `breaker` a task stops calling for a while when too many
    of its last calls failed; the rows in between have no answer either.
    """
    @F.pandas_udf(_ANSWER)
    def answers(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        guard = Breaker(breaker) if breaker else None

        def answer(row: dict, near) -> tuple:
            risk, reasoning = analyze(row, [] if near is None else [dict(n) for n in near])
            return float(risk), str(reasoning)

        for redacted, similar in batches:
            jobs = [partial(answer, row, near) for row, near in zip(redacted.to_dict("records"), similar)]
            found = call_all(jobs, width, timeout_seconds, guard)
            yield pd.DataFrame([(None, None) if f is None else f for f in found], columns=["risk", "reasoning"])

    return lambda redacted, count, mean, similar: answers(redacted, similar)


def assess(rows: DataFrame, model: Model = heuristic) -> DataFrame:
    """Adds `assessment_risk`, `assessment_reasoning`, `assessment_ok`.

    `model` maps the redacted transaction (a struct), the neighbour count, the
    mean similarity and, if it has a fourth argument, the redacted neighbours
    to `struct<risk, reasoning>`; `model_of` makes one from a function. It
    never sees the row itself. An answer without reasoning or with a risk
    outside 0..100 counts as unavailable.
    """
    given = [redacted_struct(), F.col("similar_count"), F.col("similar_mean")]
    answer = model(*given, F.col("similar")) if reads_neighbours(model) else model(*given)
    usable = F.col("_answer.risk").between(0, V.MAX_SCORE) & F.col("_answer.reasoning").isNotNull()
    return rows.withColumn("_answer", answer).withColumns({
        "assessment_ok": F.coalesce(usable, F.lit(False)),
        "assessment_risk": F.when(usable, F.col("_answer.risk")).cast(SCORE),
        "assessment_reasoning": F.col("_answer.reasoning"),
    }).drop("_answer", "similar")


def history_risk(rows: DataFrame) -> DataFrame:
    """Adds `history_risk`: the amount relative to the mean of the recent history."""
    mean = history_mean()
    ratio = F.col("amount").cast("double") / mean
    raw = (ratio - F.lit(1.0)) * F.lit(V.HISTORY_SLOPE) + F.lit(V.HISTORY_BASE)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))
    return rows.withColumn(
        "history_risk",
        F.when(F.col("history_count") == 0, F.lit(V.NO_HISTORY_SCORE))
        .when(F.col("history_sum") == 0, F.lit(V.ZERO_MEAN_SCORE))
        .otherwise(F.round(score, 2).cast("string")).cast(SCORE),
    )


def _weight(value: float) -> Column:
    return F.lit(Decimal(repr(value)))


def score(rows: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Weighs gate, assessment and history into `risk_score`, `decision`, `reasoning`.

    `assessment_ok` and `history_ok` say which parts are available, default
    true. A missing part is left out and its weight leaves the divisor.
    """
    ok = {
        name: F.coalesce(F.col(name), F.lit(False)) if name in rows.columns else F.lit(True)
        for name in ("assessment_ok", "history_ok")
    }
    a, h = ok["assessment_ok"], ok["history_ok"]
    zero = F.lit(0).cast("decimal(30,12)")

    def part(present: Column, name: str, weight: float) -> Column:
        value = (F.col(name) * _weight(weight)).cast("decimal(30,12)")
        return F.when(present, value).otherwise(zero)

    total = (
        (F.col("gate_score") * _weight(cfg.gate_weight)).cast("decimal(30,12)")
        + part(a, "assessment_risk", cfg.assessment_weight)
        + part(h, "history_risk", cfg.history_weight)
    ).cast("decimal(30,12)")
    g, wa, wh = cfg.gate_weight, cfg.assessment_weight, cfg.history_weight
    weighted = (
        F.when(a & h, total / _weight(g + wa + wh))
        .when(a, total / _weight(g + wa))
        .when(h, total / _weight(g + wh))
        .otherwise(total / _weight(g))
    )
    whole = F.floor("_score")
    approve, flag, block = V.DECISIONS
    decision = F.when(whole < cfg.approve_max, approve).when(whole < cfg.flag_max, flag).otherwise(block)
    reasoning = F.concat_ws(
        V.REASONING_SEPARATOR,
        fill(V.GATE_REASONING, reason=F.col("gate_reason")),
        F.when(a, fill(V.ASSESSMENT_REASONING, reasoning=F.col("assessment_reasoning"))),
        F.when(h, fill(V.HISTORY_REASONING, count=F.col("history_count"))),
        fill(V.SCORE_REASONING, score=as_text(F.col("_score"), 2)),
    )
    # Expanding a one-element array fixes the three values: a filter on them
    # would otherwise carry the whole computation down with it, once per use.
    result = F.struct(
        F.col("_score").alias("risk_score"), decision.alias("decision"), reasoning.alias("reasoning"))
    return (
        rows.withColumn("_score", _clamp(F.round(weighted, 2).cast("decimal(20,2)")).cast(SCORE))
        .select("*", F.inline(F.array(result))).drop("_score")
    )


def decide_early(rows: DataFrame) -> DataFrame:
    """Decisions the gate settles alone: approved and blocked rows."""
    approve, flag, _ = V.DECISIONS
    return rows.filter(F.col("gate_decision") != flag).withColumns({
        "decision": F.col("gate_decision"),
        "risk_score": F.col("gate_score"),
        "reasoning": F.when(F.col("gate_decision") == approve, V.APPROVED_REASONING)
        .otherwise(fill(V.GATE_REASONING, reason=F.col("gate_reason"))),
    })


def decision_faults(decided: DataFrame) -> DataFrame:
    """Rows with an empty field, an unknown decision or a score outside 0..100; there must be none."""
    good = (
        F.col("decision").isin(*V.DECISIONS)
        & F.col("risk_score").between(0, V.MAX_SCORE)
        & F.col("reasoning").isNotNull()
    )
    return decided.filter(~F.coalesce(good, F.lit(False)))
