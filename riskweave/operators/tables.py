"""Keyed tables without a table format: latest row per key, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """The last written row of every key.

    Of rows written together the one with the latest time stands, then the
    largest amount, then the largest hash of all columns. The rank filter also
    runs before the shuffle, so a key with very many copies sends one row per
    task.
    """
    ties = [F.desc(c) for c in ("occurred_at", "amount") if c in rows.columns]
    newest = Window.partitionBy(key).orderBy(F.desc(order), *ties, F.desc(F.xxhash64(*rows.columns)))
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def transaction_by_id(transactions: DataFrame, id: str) -> DataFrame:
    return transactions.filter(F.col("id") == id)


def transactions_by_ids(transactions: DataFrame, ids: DataFrame) -> DataFrame:
    """Transactions whose id is listed; unknown ids have no row, repeated ids one."""
    return transactions.join(ids.select("id"), "id", "left_semi")


def newer_than(transactions: DataFrame, since: Column) -> DataFrame:
    return transactions.filter(F.col("occurred_at") > since)

