"""Stored tables, read with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schemas import EMBEDDINGS, OUTBOX, TRANSACTIONS, USAGE


def read_table(spark: SparkSession, schema: T.StructType, path: str | None = None, format: str = "parquet",
               **options: str) -> DataFrame:
    """File formats get the schema; a database (`format="jdbc"`) is cast to it."""
    reader = spark.read.format(format).options(**options)
    if format == "jdbc":
        return reader.load().select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return reader.schema(schema).load(path)


def read_transactions(spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, TRANSACTIONS, path, format, **options)


def read_embeddings(spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, EMBEDDINGS, path, format, **options)


def read_outbox(spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, OUTBOX, path, format, **options)


def read_usage(spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str) -> DataFrame:
    return read_table(spark, USAGE, path, format, **options)
