"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import scratch_dir

#: Copies of the small side of a salted join; a key with a third of all rows is spread over as many tasks.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str, hashes: Iterable[str] = (), path: str | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back; arrays of hashes are written without dictionaries.

    Cuts the lineage: what several jobs read is computed once, and survives
    the loss of the executors that computed it. Who gives the path may remove
    it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, name)
    plain = {f"parquet.enable.dictionary#{c}.list.element": "false" for c in hashes}
    df.write.options(compression="zstd", **plain).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps for later tasks.

    Functions travel by value, so their module's names are new in each task;
    a module of the worker's own is not.
    """
    home = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if key not in vars(home):
        vars(home)[key] = make()
    return vars(home)[key]


def forget() -> None:
    """Let go of what `kept` holds, for operators that need the room."""
    home = sys.modules.get("_kept_by_worker")
    if home is not None:
        vars(home).clear()


#: Rows and bytes that go to a Python worker at once; texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 * 1024 * 1024}


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session that sends small batches to Python workers."""
    for key, most in BATCH.items():
        df.sparkSession.conf.set(key, most)
    return df


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(column: str = "doc_id") -> Column:
    """An id for Python workers: as text, since pandas has no whole numbers beside nulls."""
    return F.col(column).cast("bigint").cast("string").alias(column)


def id_number(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("bigint"))


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows, of which many may share one key, with slim rows of which each key has one."""
    salt = free_name("_salt", rows, few)
    # By content, so that a task that runs again deals its rows in the same way.
    content = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int"))
    copied = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copied.hint("merge"), [key, salt], how).drop(salt)


def bucket_bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = 10_000) -> list:
    """Values of the key that cut the rows into ranges of about equal size.

    The first value of every range but the lowest. They are read from a
    mergeable quantile sketch, so the driver gets at most `most` numbers.
    """
    n = df.filter(F.col(key).isNotNull()).count()
    buckets = min(most, -(-n // rows_per_bucket))
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, shares, 10 * most).alias("at")).first()["at"]
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list) -> Column:
    """Number of the range that a key is in; null keys are in range 0."""
    if not bounds:
        return F.lit(0)
    at = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(at, lambda b: b <= key)), F.lit(0))


def skewed_join(rows: DataFrame, unique: DataFrame, key: str, size: str, limit: int = 256) -> DataFrame:
    """Inner join of rows with one row per key that tells how many rows (`size`) the key has.

    Keys with more than `limit` rows are salted; those are at most one in
    `limit` of all rows.
    """
    others = [c for c in unique.columns if c != key]
    frequent = unique.filter(F.col(size) > limit).select(key, F.struct(*others).alias("_frequent"))
    marked = salted_join(rows, frequent, key, "left")
    many = marked.filter(F.col("_frequent").isNotNull()).select(*rows.columns, "_frequent.*")
    few = marked.filter(F.col("_frequent").isNull()).drop("_frequent").join(unique.filter(F.col(size) <= limit), key)
    return many.unionByName(few.select(*many.columns))
