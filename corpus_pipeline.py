"""Documents to packed training sequences, in stages that each write and read a table.

Each stage takes what its predecessor kept. All but the last return the
columns of documents and no others; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import stored, table, text_or_empty
from riskweave.llm.ledger import findings, mask_spans, scan_new
from riskweave.llm.neardup import near_duplicates
from riskweave.llm.packing import Evolution, pack_documents
from riskweave.llm.passages import dedup_passages
from riskweave.llm.toxicity import fit, score_with
from riskweave.session import scratch_dir


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _changed(docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of documents, with n_chars counted anew where the text changed."""
    n_chars = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_with(docs.select(*COLUMNS), model).filter(F.col("toxicity") < 0.5).select(*COLUMNS)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; one that has nothing left goes."""
    changed = F.col("removed_chars") > 0
    found = dedup_passages(docs.select(*COLUMNS)).filter(~changed | (F.btrim("text", F.lit(" \t\r\n\f\v")) != ""))
    return _changed(found, changed)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every class of near duplicates; a row that repeats another goes too."""
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty()) == F.col("_hash"))
    rows = docs.select(*COLUMNS).join(kept, same, "left_semi")
    others = [c for c in COLUMNS if c != "doc_id"]
    one = rows.groupBy("doc_id", F.xxhash64(text_or_empty()).alias("_hash")).agg(F.min(F.struct(*others)).alias("_row"))
    return one.select("doc_id", *[F.col(f"_row.{c}").alias(c) for c in others])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret."""
    ledger = scratch_dir(spark, "ledger")
    text = text_or_empty()
    scan_new(docs.select(F.col("doc_id").alias("path"), text.alias("content")), ledger)
    found = findings(docs.select(*COLUMNS).withColumn("blob", F.sha2(text.cast("binary"), 256)), ledger)
    changed = F.size("spans") > 0
    masked = F.when(changed, mask_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return _changed(found.withColumn("text", masked), changed)


#: Packings that compete in a shard; one that meets the lower bound ends its island's work.
EVOLUTION = Evolution(islands=4, epochs=4, population=8, children=16, elites=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences."""
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), how=EVOLUTION)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", delete_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the alignment; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
