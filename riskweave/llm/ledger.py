"""Secret scans that look at every content once per rule version.

Content is addressed by its hash: all versions of a path, and all paths with
one content, share a blob. A ledger in the shared folder notes which blobs
were scanned with which version of which rule, and what was found. A scan
reads only blobs with a rule version that the ledger lacks, and joins the
findings back to every path.

Null content is empty. A null path is a path like any other. Repeated rows
come back as often as they came. Spans count code points, the end excluded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import forget, free_name, salted_join, small_batches
from riskweave.session import scratch_dir

#: Rules in the order in which spans of one start are listed: kind, version, pattern, group that is measured, least length.
RULES = (
    ("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 1, r"[0-9a-f]+", 0, 16),
)

#: A quicker pattern with the same long matches: a run either is long enough from its start or nowhere.
QUICK = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}

SPAN = "struct<kind:string,start:bigint,end:bigint>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"


def rule_ids(rules: Iterable = RULES) -> list[str]:
    return [f"{kind}@{version}" for kind, version, *_ in rules]


def spans_of(text: str, pattern: re.Pattern, group: int, least: int) -> list[tuple[int, int]]:
    """Matches, leftmost first and without overlap, whose measured part is long enough."""
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def _scanner(rules: tuple):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        compiled = {
            f"{kind}@{version}": (kind, re.compile(QUICK.get(kind, pattern) if (kind, version, pattern, group, least) in RULES
                                                   else pattern, re.ASCII), group, least)
            for kind, version, pattern, group, least in rules
        }
        for batch in batches:
            out: dict[str, list] = {"blob": [], "rule": [], "spans": []}
            for blob, content, todo in zip(batch["blob"], batch["content"], batch["todo"], strict=True):
                for rule in todo:
                    kind, pattern, group, least = compiled[rule]
                    out["blob"].append(blob)
                    out["rule"].append(rule)
                    out["spans"].append([
                        {"kind": kind, "start": a, "end": b} for a, b in spans_of(content, pattern, group, least)])
            yield pd.DataFrame(out)

    return scan


def scan_new(versions: DataFrame, ledger: str, rules: tuple = RULES) -> None:
    """Scan (path, content) rows: every blob with the rule versions that the ledger lacks for it."""
    spark = small_batches(versions).sparkSession
    wanted = F.array(*[F.lit(r) for r in rule_ids(rules)])
    blobs = versions.select(
        F.sha2(F.col("content").cast("binary"), 256).alias("blob"), "content").dropDuplicates(["blob"])
    if _exists(spark, ledger):
        seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    else:
        todo = wanted
    unseen = blobs.select("blob", "content", todo.alias("todo")).filter(F.size("todo") > 0)
    unseen.mapInPandas(_scanner(rules), LEDGER).write.mode("append").parquet(ledger)


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def in_order(spans: Column, rules: tuple = RULES) -> Column:
    """Spans by start, then by kind as the rules list them."""
    place = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule[0], i)])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def findings(paths: DataFrame, ledger: str, rules: tuple = RULES) -> DataFrame:
    """Join the ledger's findings to all rows; `paths` has a column blob and any others. Adds or replaces `spans`."""
    spark = paths.sparkSession
    known = spark.read.schema(LEDGER).parquet(ledger).filter(
        F.col("rule").isin(rule_ids(rules)) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    found = free_name("_found", paths)
    by_blob = known.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias(found))
    joined = salted_join(paths, by_blob, "blob", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return joined.withColumn("spans", F.coalesce(in_order(F.col(found), rules), none)).drop(found)


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules: tuple = RULES) -> DataFrame:
    """Scan what is new and return (path, blob, spans) for every row of (path, content)."""
    ledger = ledger or scratch_dir(versions.sparkSession, "ledger")
    rows = versions.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    scan_new(rows, ledger, rules)
    return findings(rows.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("blob")), ledger, rules)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_spans(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every stretch that spans cover replaced by one mask each."""
    start = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
                     F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(F.lit(""))).alias("out"),
            s["end"].alias("at"))))
    return F.concat(start["out"], F.substr(text, start["at"].cast("int") + 1))
