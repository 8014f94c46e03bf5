"""Conversations brought into order by the cheapest edits.

The roles of a conversation must read: nothing, or an optional system turn
and then pairs of user and assistant. Each row is kept, given the role user or
assistant, or deleted, and empty turns may be inserted anywhere. Blank and
repeated rows have to go; a row that breaks off in mid sentence costs extra
when it stays. Of the cheapest sequences of edits the one whose initials are
least in ASCII order is taken.

The cost of what is left to do depends on four states (nothing yet, after
system, after user, after assistant). Conversations are cut into blocks of
about the square root of their rows. Backward cost vectors are kept at the
borders of blocks only; a block's vectors are computed again when the walk
forward passes through it. A block is one row of symbols, so that blocks of
one conversation are worked on in different tasks: first the least costs
between its states at both ends, then the vectors at the borders, then the
walk from each state it may be entered in, then the choice of the walk.

Null role and text are one space, a null conv_id is a conversation of its own.
Rows of one turn are in the order of role and text (its first letters, then a
hash). Repeated rows are duplicates, the first is not. Extra columns are left
out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import kept, salted_join, small_batches, stored
from riskweave.llm.ordered import dealt_in_order, numbered, stretches

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, BROKEN = 2, 5, 1, 5
NEVER = 1 << 60

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Where a turn of a chosen role leads to.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
ROLE = {"u": "user", "a": "assistant"}

#: What is left to pay after the last row.
END = (0, 2 * INSERT, INSERT, 0)

#: A conversation of fewer rows is one block.
LEAST_BLOCK = 64


def before(symbol: str, after: tuple) -> tuple:
    """Costs before a row, by state, from those after it."""
    base = [DELETE + c for c in after]
    if symbol != "x":
        extra = BROKEN if symbol.isupper() else 0
        stays = KEEP[symbol.lower()]
        for s in range(4):
            base[s] = min(base[s], extra + REROLE + after[NEXT[s]])
            if stays[s] is not None:
                base[s] = min(base[s], extra + after[stays[s]])
    return tuple(min(base[s], INSERT + base[NEXT[s]], 2 * INSERT + base[NEXT[NEXT[s]]]) for s in range(4))


def between(symbols: str) -> list[int]:
    """Least costs from each state before a block to each state after it, row by row of a 4 x 4 matrix."""
    columns = []
    for t in range(4):
        costs = tuple(0 if s == t else NEVER for s in range(4))
        for symbol in reversed(symbols):
            costs = before(symbol, costs)
        columns.append(costs)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(symbols: str, after: tuple, state: int, last: bool) -> tuple[list[str], int, int]:
    """The edits of each row of a block, the state after it, and what they cost.

    Edits are initials; inserted and reroled ones have the new role's behind.
    Those inserted at the very end are with the last row.
    """
    vectors = [after]
    for symbol in reversed(symbols):
        vectors.append(before(symbol, vectors[-1]))
    vectors.reverse()
    edits, made, cost, i = [], "", 0, 0
    while i < len(symbols):
        symbol, now, then = symbols[i], vectors[i], vectors[i + 1]
        if now[state] == DELETE + then[state]:
            made, paid, to, i = made + "D", DELETE, state, i + 1
        elif now[state] == INSERT + now[NEXT[state]]:
            made, paid, to = made + ("Ia" if NEXT[state] == 3 else "Iu"), INSERT, NEXT[state]
        else:
            extra = BROKEN if symbol.isupper() else 0
            stays = KEEP[symbol.lower()][state]
            if stays is not None and now[state] == extra + then[stays]:
                made, paid, to, i = made + "K", extra, stays, i + 1
            else:
                made, paid, to, i = made + ("Ra" if NEXT[state] == 3 else "Ru"), extra + REROLE, NEXT[state], i + 1
        cost, state = cost + paid, to
        if i > len(edits):
            edits.append(made)
            made = ""
    while last and END[state]:
        edits[-1] += "Ia" if NEXT[state] == 3 else "Iu"
        cost, state = cost + INSERT, NEXT[state]
    return edits, state, cost


_between = F.pandas_udf(lambda symbols: symbols.map(between), T.ArrayType(T.LongType()))


WALKS = T.StructType([
    T.StructField("edits", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("exits", T.ArrayType(T.IntegerType())),
    T.StructField("costs", T.ArrayType(T.LongType())),
])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _border_costs(matrices: pd.Series) -> pd.Series:
    """For each block of a conversation, from the matrices of all in order, the costs behind it."""
    def of(blocks):
        costs, found = list(END), []
        for m in reversed(blocks):
            found.append(costs)
            costs = [min(int(m[4 * s + t]) + costs[t] for t in range(4)) for s in range(4)]
        return found[::-1]

    return matrices.map(of)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _entered(exits: pd.Series) -> pd.Series:
    """The state in which each block is entered, from the states that all blocks in order lead to."""
    def of(blocks):
        state, found = 0, []
        for to in blocks:
            found.append(state)
            state = int(to[state])
        return found

    return exits.map(of)


@F.pandas_udf(WALKS)
def _walks(symbols: pd.Series, after: pd.Series, blocks: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Walks through a block: of a conversation's only one from the start, of others from each state."""
    known = kept(("walks",), lambda: lru_cache(1 << 14)(walk))
    out: dict[str, list] = {"edits": [], "exits": [], "costs": []}
    for text, costs, n, at_end in zip(symbols, after, blocks, last, strict=True):
        costs = END if costs is None else tuple(map(int, costs))
        found = [known(text, costs, s, bool(at_end)) for s in range(1 if n == 1 else 4)]
        for i, name in enumerate(out):
            out[name].append([f[i] for f in found])
    return pd.DataFrame(out)


def _cleaned(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text without nulls (but for turn), and what rows of one turn are ordered by."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(text("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.select("*", F.substr("role", F.lit(1), F.lit(8)).alias("tie1"), F.substr("text", F.lit(1), F.lit(16)).alias("tie2"),
                       F.xxhash64("role", "text").alias("tie3"))


ORDER = ["tie1", "tie2", "tie3"]


def _in_turn() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), *map(F.col, ORDER)]


def find_faults(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) in order, without texts.

    Returns conv (the id as text, a space for none), turn, pos, initial (s, u,
    a or o for others), fault (blank, duplicate, truncated or none), block and
    blocks, and the order of equal turns.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.substr("role", F.lit(1), F.lit(1))
    content = F.md5(F.concat_ws(":", F.length("conv"), "conv", F.length("role"), "role", "text").cast("binary"))
    slim = _cleaned(rows).select(
        "conv", "turn", *ORDER, F.unhex(content).alias("content"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o")).alias("initial"),
        F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").alias("own"))
    dealt = dealt_in_order(slim, "conv", _in_turn())
    repeated = dealt.groupBy("content").agg(F.min("_at").alias("_earliest"), F.count("*").alias("_times")).filter("_times > 1")
    length = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("_rows"))).cast("bigint")
    parts = stretches(dealt, "conv")
    found = salted_join(numbered(dealt, parts, "conv"), repeated.drop("_times"), "content", "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("_at") > F.col("_earliest"), "duplicate").otherwise(F.col("own"))
    return found.select(
        "conv", "turn", *ORDER, "pos", "initial", fault.alias("fault"),
        F.floor(F.col("pos") / length).alias("block"), F.ceil(F.col("_rows") / length).alias("blocks"))


def plan_edits(faults: DataFrame) -> DataFrame:
    """One row per block of rows from `find_faults`.

    Returns conv, block, its rows in order with their edits, cost, and counts
    of its faults and of neighbours in a wrong order.
    """
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    kinds = ("blank", "duplicate", "truncated")
    cells = faults.groupBy("conv", "block", "blocks").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn", *ORDER, "initial", symbol.alias("symbol")))).alias("rows"),
        *[F.count_if(F.col("fault") == kind).alias(kind) for kind in kinds])
    joined = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    cells = cells.select("*", joined("symbol").alias("symbols"), joined("initial").alias("initials"),
                         (F.col("block") == F.col("blocks") - 1).alias("last"))

    by_block = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("block", F.col(value).alias("v")))), lambda b: b["v"])
    several = cells.filter("blocks > 1").select("conv", "block", _between("symbols").alias("m"), F.right("initials", F.lit(1)).alias("end"))
    borders = several.groupBy("conv").agg(by_block("m").alias("m"), by_block("end").alias("ends"))
    borders = borders.select("conv", F.posexplode(F.arrays_zip(_border_costs("m").alias("after"), F.expr("slice(concat(array(''), ends), 1, size(ends))").alias("prior"))).alias("block", "b"))
    borders = borders.select("conv", F.col("block").cast("bigint").alias("block"), F.col("b.after").alias("after"), F.col("b.prior").alias("prior"))
    walked = cells.join(borders, ["conv", "block"], "left").withColumn("w", _walks("symbols", "after", "blocks", "last"))
    entries = walked.filter("blocks > 1").select("conv", "block", F.col("w.exits").alias("exits"))
    entries = entries.groupBy("conv").agg(by_block("exits").alias("exits")).select(
        "conv", F.posexplode(_entered("exits")).alias("block", "entry"))
    chosen = walked.join(entries.withColumn("block", F.col("block").cast("bigint")), ["conv", "block"], "left")
    entry = F.coalesce("entry", F.lit(0))
    seen = F.concat(F.coalesce("prior", F.lit("")), F.col("initials"))
    legal = F.regexp_count(seen, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    return chosen.select(
        "conv", "block", *kinds, (F.length(seen) - 1 - legal).cast("bigint").alias("illegal"),
        F.get("w.costs", entry).alias("cost"), F.arrays_zip("rows", F.get("w.edits", entry).alias("edits")).alias("rows"))


def summarised(rows: DataFrame, faults: DataFrame, plan: DataFrame) -> DataFrame:
    """For every conv_id of `rows`: gaps between turns, counts of faults, cost and initials of the edits."""
    wide = lambda c: c.cast("decimal(20,0)")
    turns = faults.groupBy("conv").agg(F.min("turn").alias("_least"), F.max("turn").alias("_most"), F.count_distinct("turn").alias("_turns"))
    gaps = F.coalesce((wide(F.col("_most")) - wide(F.col("_least")) + 1 - F.col("_turns")).try_cast("bigint"), F.lit(0))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    initials = F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["edits"]), ""), "[a-z]", "")
    audits = plan.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", initials.alias("a")))), lambda b: b["a"]), "").alias("audit"))
    every = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    found = every.join(turns, "conv", "left").join(audits, "conv", "left")
    return found.select(
        "conv", gaps.alias("gaps"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))


REPAIRED = "conv string, role string, text string"


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Applies edits to texts: the edits of a place in the order come before its texts, one for each."""
    waiting: deque[str] = deque()
    for batch in batches:
        out: list[tuple] = []
        for conv, edits, role, text in zip(batch["conv"], batch["edits"], batch["role"], batch["text"], strict=True):
            if edits is not None:
                waiting.append(edits)
                continue
            made = waiting.popleft()
            i = 0
            while i < len(made):
                if made[i] == "K":
                    out.append((conv, role, text))
                elif made[i] == "I":
                    out.append((conv, ROLE[made[i + 1]], ""))
                elif made[i] == "R":
                    out.append((conv, ROLE[made[i + 1]], text))
                i += 1 + (made[i] in "IR")
        yield pd.DataFrame(out, columns=["conv", "role", "text"])


def repaired_rows(rows: DataFrame, plan: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of all repaired conversations in order: conv, role, text.

    They are in ranges, which divide a large conversation. With `whole`, each
    conversation passes through one task, row by row.
    """
    texts = _cleaned(rows)
    edits = plan.select("conv", F.explode("rows").alias("r")).select("conv", "r.rows.turn", *[f"r.rows.{c}" for c in ORDER], "r.rows.pos", "r.edits")
    none = lambda kind: F.lit(None).cast(kind)
    both = edits.select("*", none("string").alias("role"), none("string").alias("text")).unionByName(
        texts.withColumns({"pos": none("bigint"), "edits": none("string")}))
    place = ["conv", *_in_turn()]
    dealt = both.repartition("conv") if whole else both.repartitionByRange(*place)
    small_batches(rows)
    return dealt.sortWithinPartitions(*place, F.col("pos").asc_nulls_last()).select("conv", "edits", "role", "text").mapInPandas(_edited, REPAIRED)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for now, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
            if now != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = now, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
    if conv is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines; from rows that `repaired_rows` gives whole. Empty ones have no row."""
    return repaired.mapInPandas(_digests, "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats
    it, 4 makes its role user. Nulls are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("f")).filter("f <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations with faults and edits, edits by block of rows, faults by row) of rows (conv_id, turn, role, text)."""
    faults = stored(find_faults(rows), "faults")
    plan = stored(plan_edits(faults), "edits")
    return summarised(rows, faults, plan), plan, faults
