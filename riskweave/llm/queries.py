"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import table, text_or_empty
from riskweave.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.neardup import NearDup, near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, NearDup(words=4)).drop("text_hash")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.passages import dedup_passages

    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.binary import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.ledger import RULES, joined_spans, scan_secrets

    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs.select(F.col("doc_id").alias("path"), text_or_empty().alias("content")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = joined_spans(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"), *[count(rule[0]).alias(f"n_{rule[0]}") for rule in RULES],
        F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.bpe import encode_digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.pages import extract_main_text

    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.search import top_k

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.trie import prefix_trie, rebuilt, with_end_digests

    found, ends = prefix_trie(rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return with_end_digests(found, ends)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.repair import damaged, digests, repair_conversations, repaired_rows, summarised

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    _, plan, faults = repair_conversations(rows)
    digest = digests(repaired_rows(rows, plan, whole=True))
    found = summarised(given, faults, plan).join(digest, "conv", "left")
    return found.select(
        F.col("conv").try_cast("bigint").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskweave.llm.warc import capture_index, with_payload_facts, write_archives

    folder = scratch_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return with_payload_facts(capture_index(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from riskweave.llm import oracles

    return {name: sql for name, sql in vars(oracles).items() if name.startswith("op")}
