"""Tables a stream writes: one partition per micro-batch.

A micro-batch that runs again replaces its own partition, so it leaves the
same rows. Readers see the last written row of every id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.outbox import outbox_purge_count, outbox_retained
from riskweave.operators.tables import upsert_latest
from riskweave.schemas import OUTBOX, TRANSACTIONS
from riskweave.session import cut, remove

# Ids that came again with other content, with their accounts then and now.
CHANGED = T.StructType([T.StructField("id", T.StringType()), T.StructField("account", T.StringType())])


def write_batch(rows: DataFrame, root: str, table: str, batch_id: int, day_of: str | None = None) -> None:
    """Write one partition; `day_of` names a time column to divide it by day as well."""
    keys = ["batch_id"]
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if day_of:
        keys.append("day")
        rows = rows.withColumn("day", F.to_date(day_of))
    _overwrite(rows, root, table, keys)


def read_batch(spark: SparkSession, root: str, table: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
    """The rows of one partition, found without listing the others; None if nothing was written."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}/batch_id={batch_id}").select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_all(spark: SparkSession, root: str, table: str, schema: T.StructType, by_day: bool = False) -> DataFrame:
    """Every written row with its `batch_id`, and its `day` if the table has one."""
    keys = [T.StructField("batch_id", T.LongType())] + [T.StructField("day", T.DateType())] * by_day
    return spark.read.schema(T.StructType([*schema.fields, *keys])).parquet(f"{root}/{table}")


def read_latest(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    return upsert_latest(read_all(spark, root, table, schema), order="batch_id").drop("batch_id")


def save_batch(spark: SparkSession, rows: DataFrame, root: str, batch_id: int):
    """Save the transactions of a micro-batch and note which ids changed.

    Returns the table as it stands, with `ingest_seq`, and the accounts of
    changed rows, old and new; None if no id ever changed. Finding earlier
    deliveries reads four columns of the stored transactions.
    """
    write_batch(rows, root, "transactions", batch_id, day_of="occurred_at")

    def stored() -> DataFrame:
        return read_all(spark, root, "transactions", TRANSACTIONS, by_day=True).filter(
            F.col("batch_id") <= batch_id).withColumnRenamed("batch_id", "ingest_seq")

    content = ["from_account", "to_account", "amount", "occurred_at"]
    copies = stored().select("id", *content).join(rows.select("id").distinct(), "id", "left_semi").distinct()
    changed = copies.groupBy("id").agg(
        F.count("*").alias("n"), F.flatten(F.collect_set(F.array("from_account", "to_account"))).alias("accounts"))
    write_batch(changed.filter("n > 1").select("id", F.explode("accounts").alias("account")).distinct(),
                root, "changed", batch_id)
    known = read_all(spark, root, "changed", CHANGED)
    if known.isEmpty():
        return stored, None

    def standing() -> DataFrame:
        ids = known.select("id").distinct()
        last = upsert_latest(stored().join(ids, "id", "left_semi"))
        return stored().join(ids, "id", "left_anti").unionByName(last)

    return standing, known.select("account")


def purge_outbox(spark: SparkSession, root: str, cutoff: Column) -> int:
    """Remove outbox rows before the cutoff in place; returns how many.

    Days before the cutoff's go as whole partitions; only the cutoff's own
    day is rewritten. A run that breaks off can be repeated.
    """
    rows = read_all(spark, root, "outbox", OUTBOX, by_day=True).filter(F.col("day") <= F.to_date(cutoff))
    purged = outbox_purge_count(rows, cutoff).first().purged
    last = F.col("day") == F.to_date(cutoff)
    kept = cut(outbox_retained(rows.filter(last), cutoff))
    partitions = rows.select("batch_id", "day", last.alias("is_last")).distinct().collect()
    full = {(r.batch_id, r.day) for r in kept.select("batch_id", "day").distinct().collect()}
    for part in partitions:
        if not part.is_last or (part.batch_id, part.day) not in full:
            remove(spark, f"{root}/outbox/batch_id={part.batch_id}/day={part.day}")
    _overwrite(kept, root, "outbox", ["batch_id", "day"])
    return purged


def compact(spark: SparkSession, root: str, table: str, schema: T.StructType, upto: int, day_of: str | None = None) -> None:
    """Make one partition of all batches up to `upto`, with the last row of every id.

    The new partition stands before the old ones go: they hold nothing newer.
    """
    rows = read_all(spark, root, table, schema, by_day=bool(day_of)).filter(F.col("batch_id") <= upto)
    last = cut(upsert_latest(rows, order="batch_id").select(*schema.names))
    old = [r.batch_id for r in rows.select("batch_id").distinct().collect() if r.batch_id != upto]
    write_batch(last, root, table, upto, day_of)
    for batch_id in old:
        remove(spark, f"{root}/{table}/batch_id={batch_id}")


def _overwrite(rows: DataFrame, root: str, table: str, keys: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/{table}")
