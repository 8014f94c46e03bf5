"""Repeated passages deleted by pairwise alignment of documents.

A line ends at a line feed or after a full stop, exclamation or question mark
before a blank, so that passages in the middle of a paragraph are found too.
Lines of fewer than `line_words` words are left alone and do not part a block.

A window is a run of lines that just reaches `block_words` words, counted from
its first line on or from its last line back; a block of that many words or
more is made of windows. A window that several documents hold nominates pairs:
each later holder with the first holder, which holds the whole window. The
number of pairs grows with the lines, not with the square of a window's
holders, and no window is too frequent to nominate. A pair is aligned by
patience diff: lines that are unique in both documents, in their longest
common order, are anchors; the gaps between anchors are aligned in the same
way. Runs of aligned lines without a gap in either document are blocks; lines
that alignment leaves, since they come twice or in another order, are matched
window by window. Blocks are deleted from the later document.

A line's first holder never loses it. Documents are ordered by doc_id. Lines
are compared without blanks at their ends. Null text has no lines. Rows
without doc_id take no part and stay as they are. Rows of one doc_id are not
compared with each other; repeated rows lose the same lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from riskweave.llm import runs
from riskweave.llm.common import forget, free_name, skewed_join, small_batches, stored, text_or_empty
from riskweave.session import remove, scratch_dir


@dataclass(frozen=True)
class LineDedup:
    #: Shorter lines are left alone.
    line_words: int = 4
    #: A block needs as many words to be deleted.
    block_words: int = 10


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, in order of their first parts, whose second parts rise."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(n)
        else:
            tops[at], last[at] = j, n
    out = []
    n = last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: places of aligned equal lines, rising in both."""
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[y]: y for y in range(j, j_end) if in_b[b[y]] == 1}
        anchors = rising([(x, place[a[x]]) for x in range(i, i_end) if in_a[a[x]] == 1 and a[x] in place])
        if not anchors:
            continue
        found += anchors
        corners = [(i - 1, j - 1), *anchors, (i_end, j_end)]
        todo += [(x + 1, x_end, y + 1, y_end) for (x, y), (x_end, y_end) in zip(corners, corners[1:], strict=False)]
    return sorted(found)


def windows_of(words: list[int], block_words: int, numbers: list[int] | None = None) -> list[tuple[int, int]]:
    """Shortest runs of lines with enough words, from each line on and from each back: first place, place after the last."""
    found = []
    origin = start = total = 0
    for end, n in enumerate(words):
        if numbers and end and numbers[end] != numbers[end - 1] + 1:
            origin, start, total = end, end, 0
        total += n
        if total < block_words and start > origin:
            found.append((start - 1, end + 1))
        while total >= block_words:
            found.append((start, end + 1))
            total -= words[start]
            start += 1
    return found


def left_windows(a: list[tuple], b: list[tuple], gone: set[int], block_words: int) -> list[int]:
    """Numbers of the lines of b in windows shared with a that have a line which is not gone, in any order."""

    def windows(lines: list[tuple]) -> Iterator[list[tuple]]:
        numbers, _, words = zip(*lines, strict=True)
        return (lines[start:end] for start, end in windows_of(words, block_words, numbers))

    held = {tuple(x[1] for x in window) for window in windows(a)} if a and b else set()
    left = [w for w in windows(b) if not gone.issuperset(x[0] for x in w)] if held else []
    return [x[0] for window in left if tuple(x[1] for x in window) in held for x in window]


def common_blocks(a: list[tuple], b: list[tuple], block_words: int) -> list[int]:
    """Numbers of the lines of b in blocks shared with a; lines are (number, hash, words)."""
    out: list[int] = []
    block: list[int] = []
    words = 0
    previous = None
    for i, j in [*align([x[1] for x in a], [x[1] for x in b]), (None, None)]:
        here = None if i is None else (a[i][0], b[j][0])
        if block and (here is None or here != (previous[0] + 1, previous[1] + 1)):
            if words >= block_words:
                out += block
            block, words = [], 0
        if here is not None:
            block.append(b[j][0])
            words += b[j][2]
            previous = here
    if len(out) < len(b):
        out += left_windows(a, b, set(out), block_words)
    return out


PASS = ("doc_id bigint, tie bigint, lines array<bigint>, words array<int>, spans array<bigint>, starts array<int>, "
        "ends array<int>, windows array<bigint>, marks array<bigint>, groups array<bigint>, group_spans array<bigint>")

#: Columns whose values hardly repeat.
HASHES = ("lines", "windows", "marks", "groups", "spans", "group_spans")


def _units(how: LineDedup, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashing = runs.Hashing()
        for batch in batches:
            doc_id, tie, texts = (batch.column(name) for name in ("doc_id", "tie", "text"))
            for row, end, words in runs.chunks_of(texts, hashing):
                found = {"doc_id": doc_id[row:end], "tie": tie[row:end], **runs.line_arrays(words, how.line_words, how.block_words)}
                if passage_words:
                    found |= runs.group_arrays(words, passage_words, how.block_words)
                else:
                    none = runs.lists(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), end - row)
                    found |= dict.fromkeys(("marks", "groups", "group_spans"), none)
                yield pa.RecordBatch.from_pydict(found)

    return run


def units(docs: DataFrame, how: LineDedup, passage_words: int = 0, path: str | None = None) -> DataFrame:
    """Lines, runs of lines and groups of windows of every row with a doc_id, from one pass over the texts.

    `tie` is a hash of the text. Without `passage_words` there are no groups. They are stored, below `path` if it is given.
    """
    texts = small_batches(docs).filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    return stored(texts.mapInArrow(_units(how, passage_words), PASS), "units", HASHES, path)


def _align(how: LineDedup):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "tie": [], "gone": []}
            for doc_id, tie, a, b in zip(
                    batch["doc_id"], batch["tie"], batch["lines_earlier"], batch["lines"], strict=True):
                gone = common_blocks(*([(x["nth"], x["line"], x["words"]) for x in side] for side in (a, b)), how.block_words)
                if gone:
                    gone = set(gone)
                    out["doc_id"].append(doc_id)
                    out["tie"].append(tie)
                    out["gone"].append([x["span"] for x in b if x["nth"] in gone])
            if out["gone"]:
                yield pd.DataFrame(out)

    return run


def repeated_lines(rows: DataFrame, how: LineDedup) -> DataFrame:
    """doc_id, tie, and the spans of lines that an earlier document has in a common block; rows are those of `units`.

    The result reads what this stores, not the rows.
    """
    keys = ("doc_id", "tie")
    runs_of_lines = rows.select(*keys, F.inline(F.arrays_zip(
        F.col("windows").alias("window"), F.col("starts").alias("start"), F.col("ends").alias("end"))))
    # Without the zip: all of its arrays would be read.
    alone = rows.select("doc_id", F.explode("windows").alias("window"))
    held = alone.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    found = runs_of_lines.join(held.select("window", "first").hint("shuffle_hash"), "window")
    shared = found.groupBy(*keys).agg(
        F.flatten(F.collect_set(F.sequence("start", F.col("end") - 1))).alias("nths"), F.collect_set("first").alias("firsts"))
    nths = F.array_sort(F.array_distinct("nths"))
    arrays = stored(rows.select(*keys, "lines", "words", "spans").join(shared, [*keys]).dropDuplicates([*keys]).select(
        *keys, "firsts", F.transform(nths, lambda n: F.struct(
            n.alias("nth"), F.get("lines", n).alias("line"), F.get("words", n).alias("words"),
            F.get("spans", n).alias("span"))).alias("lines")), "held-lines")
    firsts = arrays.select(F.explode("firsts").alias("earlier"), *keys).filter(F.col("earlier") < F.col("doc_id"))
    pairs = stored(firsts, "line-pairs")
    asked = pairs.groupBy("earlier").agg(F.count("*").alias("n"))
    left = arrays.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("lines_earlier")).join(asked, "earlier")
    both = skewed_join(pairs, left, "earlier", "n").select(*keys, "lines_earlier").join(
        arrays.select(*keys, "lines"), [*keys])
    gone = both.mapInPandas(_align(how), "doc_id bigint, tie bigint, gone array<bigint>")
    return gone.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


@F.pandas_udf(BinaryType())
def without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts, as bytes, without spans."""
    return pd.Series([t if s is None else runs.without(t, np.asarray(s, dtype=np.int64)) for t, s in zip(texts, spans, strict=True)])


def cut_texts(docs: DataFrame, rows: DataFrame, lines: str, spans: str) -> DataFrame:
    """All columns of docs, the text cut, `removed_lines` and `removed_chars`.

    `rows` are those of docs with the spans of lines in a column `lines`, all
    spans in a column `spans`, and null in the latter for a text that stays.
    """
    kept = free_name("_kept", rows)
    text, untouched = text_or_empty(), F.col(spans).isNull()
    # Texts that stay as they are do not go to Python workers.
    rows = rows.withColumn(kept, without_spans(F.when(~untouched, text.cast("binary")), F.col(spans)).cast("string"))
    told = {"removed_lines": F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)),
            "removed_chars": F.when(untouched, 0).otherwise(F.length(text) - F.length(kept)).cast("bigint")}
    return rows.select(
        *[(F.when(untouched, F.col("text")).otherwise(F.col(kept)) if c == "text" else F.col(c)).alias(c)
          for c in docs.columns if c not in told],
        *[column.alias(name) for name, column in told.items()])


def dedup_lines(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """All columns of docs, the text without repeated passages, and `removed_lines` and `removed_chars`.

    Columns of docs that have the names of the last two are replaced.
    """
    key, tie, gone = (free_name(name, docs) for name in ("_id", "_tie", "_gone"))
    folder = scratch_dir(docs.sparkSession, "units")
    found = repeated_lines(units(docs, how, path=folder), how).select(
        F.col("doc_id").alias(key), F.col("tie").alias(tie), F.col("gone").alias(gone))
    remove(docs.sparkSession, folder)
    rows = docs.join(found, (F.col("doc_id") == F.col(key)) & (F.xxhash64(text_or_empty()) == F.col(tie)), "left")
    return cut_texts(docs, rows, gone, gone)
