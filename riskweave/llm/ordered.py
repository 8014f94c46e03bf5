"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import stored, tasks

#: The bits of monotonically_increasing_id below the number of the partition.
ROW_BITS = 33


def dealt_in_order(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The rows in ranges over (key, order), with `_at`: their place in the order of all rows.

    A key is in as many ranges as it has rows for, so none is too large; only
    rows that are equal in key and order share a range for sure. `_at` rises
    with (key, order) and is written, so that each reader sees the same.
    """
    rows = stored(rows, "slim")
    dealt = rows.repartitionByRange(tasks(rows.sparkSession), key, *order).sortWithinPartitions(key, *order)
    return stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")


def range_number() -> Column:
    return F.shiftright("_at", ROW_BITS)


def stretches(dealt: DataFrame, key: str) -> DataFrame:
    """(key, _range, _first, _before, _rows) for each key and range: first place there, rows of the key before it and in all."""
    found = dealt.groupBy(key, range_number().alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_key = Window.partitionBy(key)
    so_far = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(
        key, "_range", "_first", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"),
        F.sum("_n").over(of_key).alias("_rows"))


def numbered(dealt: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Rows of `dealt_in_order` with `pos`, from 0 within their key, and the columns that `parts` (of `stretches`) has besides."""
    found = dealt.withColumn("_range", range_number()).join(parts, [key, "_range"])
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_range", "_first", "_before")
