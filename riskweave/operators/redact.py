"""Removal of personal data before anything leaves the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions.text import pseudonym, scrub


def _redacted() -> list[Column]:
    return [
        F.col("id"), F.col("amount"),
        pseudonym(F.col("from_account")).alias("redacted_from_account"),
        pseudonym(F.col("to_account")).alias("redacted_to_account"),
        scrub(F.col("description")).alias("redacted_description"),
        F.col("occurred_at"),
    ]


def redact_transactions(transactions: DataFrame) -> DataFrame:
    """Accounts become pseudonyms and the description is scrubbed; id, amount and time stay."""
    return transactions.select(*_redacted())


def redacted_struct() -> Column:
    """The redacted form of a transaction row as one column."""
    return F.struct(*_redacted())


def redact_texts(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.withColumn(column, scrub(F.col(column)))


def redaction_faults(redacted: DataFrame) -> DataFrame:
    """Rows whose pseudonym is not eight lower-case hex digits; there must be none."""
    bad = [~F.coalesce(F.col(c).rlike(V.PSEUDONYM_PATTERN), F.lit(False))
           for c in ("redacted_from_account", "redacted_to_account")]
    return redacted.filter(bad[0] | bad[1])
