"""Repeated passages deleted word by word, beside the blocks of lines that line dedup deletes.

A word goes if it lies in a run of `passage_words` words that an earlier
document has too, wherever the run starts and ends, however short its lines
and whatever blanks part its words. A document of fewer words, but of
`block_words` at least, is one run. This is exact, without pairs: every run of
that length is a window, and each window has a first holder.

Windows are as many as words, so they are not sorted one by one. A window's
mark is the least hash of the runs of a third of its words in it; neighbouring
windows mostly share theirs and make up a group. Groups of the same words have
the same windows, so all holders of a group but the first lose it whole. What is
left are marks whose groups differ, at the ends of passages and where copies were
edited: there the windows of each group's first holder are compared. A window's
first holder is among those, since the first holder of any group that has the
window has it too.

A window's first holder never loses it. Documents are ordered by doc_id, blanks
are what `str.split` parts words at. Rows are treated as line dedup does: those
without doc_id stay, those of one doc_id are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import runs
from riskweave.llm.common import free_name, small_batches, stored, text_or_empty
from riskweave.llm.linededup import LineDedup, cut_texts, repeated_lines, units
from riskweave.session import remove, scratch_dir

#: Words of a passage that is deleted wherever it starts and ends.
PASSAGE_WORDS = 50

HELD = "doc_id bigint, tie bigint, value bigint, span bigint"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = runs.Hashing()
        for batch in batches:
            doc_id, tie = (batch.column(name) for name in ("doc_id", "tie"))
            asked = batch.column("asked").to_pylist()
            for row, end, words in runs.chunks_of(batch.column("text"), hashing):
                owner, values, spans = runs.windows_in(words, [np.unique(np.array(x, dtype=np.int64)) for x in asked[row:end]], window)
                rows = pa.array(owner + row)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": doc_id.take(rows), "tie": tie.take(rows), "value": pa.array(values), "span": pa.array(spans)})

    return run


def repeated_passages(rows: DataFrame, docs: DataFrame, window: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, tie and span of passages that an earlier document has; rows are those of `units` of docs.

    The result reads what this stores, not the rows.
    """
    keys = ("doc_id", "tie")
    groups = rows.select(*keys, F.inline(F.arrays_zip(
        F.col("marks").alias("mark"), F.col("groups").alias("group"), F.col("group_spans").alias("span"))))
    # From their own column: nothing is left out of a zip of arrays, and the others are not needed to count.
    marks = rows.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    # A common mark has many rows; AQE splits them, the other side has one row for each. That side is hashed, here and
    # below, so that groups, windows and texts are not sorted.
    shared = groups.join(marks.select("mark").hint("shuffle_hash"), "mark")
    first = shared.groupBy("mark", "group").agg(F.min("doc_id").alias("first"))
    differ = first.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    # Both sides read one exchange of groups by mark.
    known = first.join(differ.select("mark", F.lit(True).alias("differ")).hint("merge"), "mark", "left")
    held = stored(shared.join(known.hint("merge"), ["mark", "group"]).select(
        *keys, "span", "first", F.coalesce("differ", F.lit(False)).alias("differ")), "held-groups")
    # On doc_id alone, so that texts move once.
    asked = held.filter("first = doc_id and differ").groupBy("doc_id").agg(F.collect_list(F.struct("tie", "span")).alias("groups"))
    texts = small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    own = F.transform(F.filter("groups", lambda g: g["tie"] == F.col("tie")), lambda g: g["span"])
    again = texts.join(asked.hint("shuffle_hash"), "doc_id").select(*keys, "text", own.alias("asked"))
    windows = stored(again.mapInArrow(_windows(window), HELD), "windows")
    least = windows.groupBy("value").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    later = windows.join(least.select("value", "first").hint("shuffle_hash"), "value")
    return held.filter("first < doc_id").select(*keys, "span").unionByName(later.filter("first < doc_id").select(*keys, "span"))


def dedup_passages(docs: DataFrame, how: LineDedup = LineDedup(), window: int = PASSAGE_WORDS) -> DataFrame:
    """All columns of docs, the text without repeated blocks of lines and passages, `removed_lines` and `removed_chars`.

    `removed_lines` counts lines of blocks; words outside them count in
    `removed_chars` alone. Columns of docs that have these names are replaced.
    """
    key, gone, cut = (free_name(name, docs) for name in ("_id", "_gone", "_cut"))
    folder = scratch_dir(docs.sparkSession, "units")
    rows = units(docs, how, window, folder)
    lines = repeated_lines(rows, how).select("doc_id", "tie", "gone", F.lit(None).cast("bigint").alias("span"))
    passages = repeated_passages(rows, docs, window).withColumn("gone", F.lit(None).cast("array<bigint>"))
    # Both have stored what they need of the rows; texts are dealt out without them on the disk.
    remove(docs.sparkSession, folder)
    found = lines.unionByName(passages).groupBy("doc_id", "tie").agg(
        F.flatten(F.collect_list("gone")).alias("gone"), F.collect_list("span").alias("spans"))
    # By doc_id alone, as the texts are dealt; one row for each.
    found = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tie", F.struct("gone", "spans")))).alias(gone))
    cuts = F.col(gone)[F.xxhash64(text_or_empty())]
    known = docs.filter(F.col("doc_id").isNotNull())
    everything = known.join(found.withColumnRenamed("doc_id", key).hint("shuffle_hash"), F.col("doc_id") == F.col(key), "left").withColumn(gone, cuts)
    everything = everything.unionByName(docs.filter(F.col("doc_id").isNull()), allowMissingColumns=True)
    everything = everything.withColumn(cut, F.concat(f"{gone}.gone", f"{gone}.spans")).withColumn(gone, F.col(f"{gone}.gone"))
    return cut_texts(docs, everything, gone, cut)
