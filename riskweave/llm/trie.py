"""A trie of the turns that conversations begin with, over vertical bitmaps.

Conversations are dealt into shards, their turns into blocks of positions. In
each cell of both, every (position, turn) has a posting: the bitset of the
shard's conversations that have this turn there. Going down, a node's bitset
is intersected with the posting of its lowest conversation's next turn; that
gives one child, and what is left the next. Population counts are the sizes.
A node of one conversation is a chain and is written as such. Nodes of equal
prefixes in different shards are then joined by a 128-bit hash of the prefix.

The hash combines a hash of each (position, turn) by exclusive or, so a block
starts with the combined hashes of those before it and needs nothing else of
them: neither a popular first turn nor a very long conversation is one task.

Sums over subtrees use one conversation per node: its smallest. What a node
counts is credited to that conversation at that depth. A node's sum is then
that of its members' credits further down: inside a cell by adding up its local
trie, beyond the block from sums by conversation.

Rows of (conv_id, turn, role, text): null role and text are empty, rows without
conv_id are left out, null turns come first, rows of one turn are in the order of
role and text (its first letters, then a hash). Repeated rows are turns of their
own. Extra columns are left out. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import skewed_join, stored, text_or_empty
from riskweave.llm.ordered import dealt_in_order, numbered, stretches


@dataclass(frozen=True)
class TrieSize:
    shard_conversations: int = 1024
    block_turns: int = 128


ROOT = bytes(16)
ORDER = ["tie1", "tie2", "tie3"]


def turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn_hash, words, _rows): all turns numbered from 0 in each conversation, and how many it has."""
    rows = rows.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                                                     text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    content = F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"))
    slim = rows.select(
        "conv", "turn", F.substr("role", F.lit(1), F.lit(8)).alias("tie1"), F.substr("text", F.lit(1), F.lit(16)).alias("tie2"),
        F.xxhash64("role", "text").alias("tie3"), F.unhex(content).alias("turn_hash"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    dealt = dealt_in_order(slim, "conv", [F.col("turn").asc_nulls_first(), *ORDER])
    return numbered(dealt, stretches(dealt, "conv"), "conv").select("conv", "pos", "turn_hash", "words", "_rows")


def rebuilt(rows: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns, as (turns, conversations).

    The first h turns of conversation c come from c - c % group (quotients
    round to zero), h being the crc32 of c's digits modulo 4; its own follow
    after its first h. Turns are (conv, pos, turn_hash, words), conversations
    (conv, leader, turns).
    """
    given = stored(turns(rows), "turns")
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("head")
    convs = given.groupBy("conv").agg(F.first("_rows").alias("own")).select("conv", "own", (F.col("conv") - F.col("conv") % group).alias("leader"), head)
    of_leader = convs.select(F.col("conv").alias("leader"), F.col("own").alias("there"))
    convs = convs.join(of_leader, "leader", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "conversations")
    tails = given.join(convs.select("conv", "head", "taken"), "conv").filter("pos >= head").select(
        "conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "turn_hash", "words")
    first = given.filter((F.col("conv") % group == 0) & (F.col("pos") < 3)).withColumnRenamed("conv", "leader")
    heads = first.join(convs.select("leader", "conv", "head"), "leader").filter("pos < head").select("conv", "pos", "turn_hash", "words")
    return tails.unionByName(heads), convs.select("conv", "leader", "turns")


CELL = "kind int, id bigint, parent bigint, depth bigint, key binary, parent_key binary, n bigint, conv bigint, words bigint, ended boolean"
NODE, EXIT = 0, 1


class Cell:
    """The local trie of one shard's conversations in one block of positions."""

    def __init__(self, rows: pd.DataFrame, block: int, block_turns: int):
        starts = rows[rows["pos"] < 0]
        rows = rows[rows["pos"] >= 0].sort_values(["conv", "pos"], kind="stable")
        conv = rows["conv"].to_numpy("int64")
        self.start = block * block_turns
        self.convs, self.first, self.count = np.unique(conv, return_index=True, return_counts=True)
        self.one, self.two = (rows[c].to_numpy("int64") for c in ("one", "two"))
        self.words = rows["words"].to_numpy("int64")
        self.total = rows["turns"].to_numpy("int64")[self.first]
        self.prefix = np.zeros((len(self.convs), 2), "int64")
        at = np.searchsorted(self.convs, starts["conv"].to_numpy("int64"))
        self.prefix[at, 0], self.prefix[at, 1] = starts["one"].to_numpy("int64"), starts["two"].to_numpy("int64")
        self.postings: list[dict] = []
        self.out: list[list] = [[] for _ in range(8)]
        self.exits: list[tuple] = []
        self.size = 0

    def index(self) -> None:
        """One bitset per (position, turn)."""
        longest = int(self.count.max())
        self.postings = [{} for _ in range(longest)]
        one, two = self.one.tolist(), self.two.tolist()
        for i, (first, n) in enumerate(zip(self.first.tolist(), self.count.tolist(), strict=True)):
            bit = 1 << i
            for p in range(n):
                turn = (one[first + p], two[first + p])
                self.postings[p][turn] = self.postings[p].get(turn, 0) | bit
        self.turn_of = lambda i, p: (one[int(self.first[i]) + p], two[int(self.first[i]) + p])
        self.present = [0] * (longest + 1)
        for p, found in enumerate(self.postings):
            for bits in found.values():
                self.present[p] |= bits

    def emit(self, parent, depth, key, parent_key, n, conv, words) -> None:
        """Add nodes, given as arrays of one length."""
        ids = np.arange(self.size, self.size + len(depth))
        self.size += len(depth)
        for place, column in enumerate((ids, parent, depth, key, parent_key, n, conv, words)):
            self.out[place].append(column)

    def chain(self, i: int, p: int, parent: int, key: tuple) -> None:
        """The rest of a single conversation's turns."""
        a, z = int(self.first[i]) + p, int(self.first[i]) + int(self.count[i])
        if a == z:
            self.leave(1 << i, parent)
            return
        k = np.empty((z - a + 1, 2), "int64")
        k[0] = key
        k[1:, 0] = key[0] ^ np.bitwise_xor.accumulate(self.one[a:z])
        k[1:, 1] = key[1] ^ np.bitwise_xor.accumulate(self.two[a:z])
        n, base = z - a, self.size
        parents = np.arange(base - 1, base + n - 1)
        parents[0] = parent
        depth = np.arange(self.start + p + 1, self.start + p + n + 1)
        self.emit(parents, depth, k[1:], k[:-1], np.ones(n, "int64"), np.full(n, self.convs[i]), self.words[a:z])
        self.leave(1 << i, base + n - 1)

    def leave(self, bits: int, node: int) -> None:
        while bits:
            low = bits & -bits
            bits ^= low
            i = low.bit_length() - 1
            self.exits.append((node, int(self.convs[i]), bool(self.start + self.count[i] == self.total[i])))

    def grow(self) -> None:
        self.index()
        groups: dict[tuple, int] = {}
        for i, key in enumerate(map(tuple, self.prefix.tolist())):
            groups[key] = groups.get(key, 0) | 1 << i
        stack = [(bits, 0, -1, key) for key, bits in groups.items()]
        while stack:
            bits, p, node, key = stack.pop()
            if not bits & (bits - 1):
                self.chain(bits.bit_length() - 1, p, node, key)
                continue
            going = bits & self.present[p]
            self.leave(bits ^ going, node)
            while going:
                i = (going & -going).bit_length() - 1
                turn = self.turn_of(i, p)
                child = going & self.postings[p][turn]
                going ^= child
                below = (key[0] ^ turn[0], key[1] ^ turn[1])
                row = int(self.first[i]) + p
                self.emit([node], [self.start + p + 1], [below], [key], [child.bit_count()], [self.convs[i]], [self.words[row]])
                stack.append((child, p + 1, self.size - 1, below))

    def frame(self) -> pd.DataFrame:
        ids, parent, depth, key, parent_key, n, conv, words = (np.concatenate(x) for x in self.out)
        text = lambda k: [row.tobytes() for row in np.ascontiguousarray(k, "int64")]
        key = text(key)
        nodes = pd.DataFrame({"kind": NODE, "id": ids, "parent": parent, "depth": depth, "key": key, "parent_key": text(parent_key),
                              "n": n, "conv": conv, "words": words, "ended": False})
        left = pd.DataFrame(self.exits, columns=["id", "conv", "ended"])
        left = left.assign(kind=EXIT, parent=-1, depth=depth[left["id"]], key=[key[i] for i in left["id"]], parent_key=ROOT, n=0, words=0)
        return pd.concat([nodes, left[nodes.columns]])


def _local_tries(block_turns: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell = Cell(rows, int(key[1]), block_turns)
        cell.grow()
        return cell.frame().assign(shard=key[0], block=key[1])

    return run


def _sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Credits of a local trie added up from the leaves; ids of children are above their parents'."""
    rows = rows.sort_values("id", kind="stable")
    nodes = rows[rows["kind"] == NODE]
    parent = nodes["parent"].tolist()
    out = {"key": [*nodes["key"], ROOT]}
    for name in ("saved", "leaves"):
        sums = rows.groupby("id")[name].sum().to_numpy("int64").tolist()
        top = 0
        for i in range(len(sums) - 1, -1, -1):
            if parent[i] >= 0:
                sums[parent[i]] += sums[i]
            else:
                top += sums[i]
        out[name] = [*sums, top if key[1] == 0 else 0]
    return pd.DataFrame(out)


def _lane(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "turn_hash")


def prefix_trie(collection: tuple[DataFrame, DataFrame], size: TrieSize = TrieSize()) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie over (turns, conversations) as `rebuilt` gives them.

    Nodes: key, conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens. Ends: key of its last node and conv_id
    of every conversation.
    """
    rows, convs = collection
    spark = rows.sparkSession
    shards = max(1, -(-convs.count() // size.shard_conversations))
    shard = F.pmod(F.xxhash64("leader"), F.lit(shards)).alias("shard")
    rows = rows.select("conv", "pos", F.floor(F.col("pos") / size.block_turns).alias("block"), _lane(1).alias("one"), _lane(2).alias("two"), "words")
    rows = stored(rows.join(convs.select("conv", "turns", shard), "conv"), "rebuilt")

    # What comes before a block, as rows of position -1; the first block has nothing before it.
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.filter(F.col("turns") > size.block_turns).groupBy("shard", "conv", "block").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    starts = blocks.select("shard", "conv", "block", F.bit_xor("one").over(before).alias("one"), F.bit_xor("two").over(before).alias("two")).filter("block > 0")
    cells = rows.unionByName(starts.withColumns({"pos": F.lit(-1), "words": F.lit(0), "turns": F.lit(0)}))
    local = stored(cells.groupBy("shard", "block").applyInPandas(
        _local_tries(size.block_turns), f"{CELL}, shard bigint, block bigint"), "local-tries")

    nodes = local.filter(F.col("kind") == NODE).groupBy("key", "parent_key", "depth").agg(
        F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("words").alias("words"))
    none = lambda kind: F.lit(None).cast(kind)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("key"), none("binary").alias("parent_key"), F.lit(0).cast("bigint").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("bigint").alias("words"))
    children = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.unionByName(root).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes, "nodes")

    # A node's own share: tokens its copies save, and whether it is a leaf.
    credit = nodes.filter("depth > 0").select(
        "key", "depth", F.col("conv_id").alias("conv"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("n_children") == 0).cast("bigint").alias("leaves")).filter("saved > 0 or leaves > 0")
    block = F.floor((F.col("depth") - 1) / size.block_turns).alias("block")
    long = convs.filter(F.col("turns") > size.block_turns).select("conv", F.sequence(F.lit(0), F.floor((F.col("turns") - 1) / size.block_turns)).alias("b"))
    by_block = credit.select("conv", block, "saved", "leaves").groupBy("conv", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    by_block = long.select("conv", F.explode("b").alias("block")).join(by_block, ["conv", "block"], "left")
    after = Window.partitionBy("conv").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    later = by_block.select("conv", "block", F.sum("saved").over(after).alias("saved"), F.sum("leaves").over(after).alias("leaves"))

    kept = ["shard", "block", "kind", "id", "parent", "key"]
    own = local.filter(F.col("kind") == NODE).select(*kept, "conv").join(credit.drop("depth"), ["key", "conv"], "left")
    beyond = local.filter((F.col("kind") == EXIT) & ~F.col("ended")).select(*kept, "conv").join(later, ["conv", "block"])
    beyond = beyond.groupBy("shard", "block", "kind", "id", "parent", "key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    both = own.select(*kept, "saved", "leaves").unionByName(beyond.select(*kept, "saved", "leaves")).fillna(0, ["saved", "leaves"])
    sums = both.groupBy("shard", "block").applyInPandas(_sums, "key binary, saved bigint, leaves bigint").groupBy("key").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    below = skewed_join(nodes.filter("depth > 0"), parents, "parent_key", "siblings")
    found = below.drop("siblings").unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", none("bigint"))).join(sums, "key", "left")
    found = found.select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    last = local.filter("ended").select("key", F.col("conv").alias("conv_id"))
    return found, last.unionByName(convs.filter("turns = 0").select(F.lit(ROOT).alias("key"), F.col("conv").alias("conv_id")))


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for now, part in batch.groupby("key", sort=False):
            ids = ",".join(part["conv_id"])
            if now != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = now, hashlib.sha256()
            else:
                ids = "," + ids
            digest.update(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def with_end_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes without key, with the SHA-256 of the ids that end there, ascending and comma-joined.

    Such a digest cannot be put together from parts: a node's ids stream through one task.
    """
    ordered = ends.repartition("key").sortWithinPartitions("key", "conv_id")
    digests = ordered.select("key", F.col("conv_id").cast("string").alias("conv_id")).mapInPandas(_end_digests, "key binary, ends_sha256 string")
    found = nodes.join(digests, "key", "left")
    return found.drop("key").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
