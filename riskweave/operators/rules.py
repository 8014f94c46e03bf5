"""The rule gate: sanctioned text, then velocity, then amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.config import RiskConfig
from riskweave.functions.text import as_text, fill, first_sanctioned
from riskweave.schemas import SCORE


def rule_gate(rows: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Adds `gate_decision`, `gate_reason`, `gate_score`; needs `velocity`.

    The first rule that hits decides. A value equal to a limit is no hit.
    """
    pattern = first_sanctioned(F.col("description"))
    fast = F.col("velocity") > cfg.velocity_limit
    large = F.col("amount") > F.lit(cfg.amount_threshold)
    approve, flag, block = V.DECISIONS
    return rows.withColumn("_pattern", pattern).withColumns({
        "gate_decision": F.when(F.col("_pattern").isNotNull(), block).when(fast | large, flag).otherwise(approve),
        "gate_score": F.when(F.col("_pattern").isNotNull(), V.BLOCK_SCORE).when(fast | large, V.FLAG_SCORE)
        .otherwise(V.APPROVE_SCORE).cast(SCORE),
        "gate_reason": F.when(F.col("_pattern").isNotNull(), fill(V.SANCTION_REASON, pattern=F.col("_pattern")))
        .when(fast, fill(V.VELOCITY_REASON, count=F.col("velocity"), limit=cfg.velocity_limit))
        .when(large, fill(V.AMOUNT_REASON, amount=as_text(F.col("amount"), 4), limit=f"{cfg.amount_threshold:f}"))
        .otherwise(V.DEFAULT_REASON),
    }).drop("_pattern")


def gate_faults(gated: DataFrame) -> DataFrame:
    """Rows on which the gate left a field empty; there must be none."""
    return gated.filter(
        F.col("gate_decision").isNull() | F.col("gate_reason").isNull() | F.col("gate_score").isNull()
    )
