"""Documents packed into token sequences by a grouping genetic algorithm.

A document longer than a sequence is cut into pieces of full length, of which
the first may be shorter; full pieces are sequences of their own. What is left
is a bin packing of lengths. Pieces are dealt by hash into shards of bounded
size. Each shard is packed on several islands: a population of packings, in
which crossover puts whole well-filled bins of one parent into the other,
takes out the bins that hold the same pieces, and places displaced pieces
where they fit best. After each epoch an island's best packings move on to
the next island of its shard. An island that meets the lower bound is done.

Null text is empty and has only the end id. Every row is packed, repeated ones
as often as they come, rows without doc_id too.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_number, id_text, small_batches, stored, text_or_empty
from riskweave.llm.tokens import encoder


@dataclass(frozen=True)
class Evolution:
    shard_items: int = 8192
    islands: int = 4
    epochs: int = 3
    population: int = 6
    children: int = 12
    elites: int = 2
    well_filled: float = 0.97


class Packing:
    """Bins of item places; finds the fullest bin that still takes an item in constant time."""

    def __init__(self, sizes: list[int], room: int):
        self.sizes, self.room = sizes, room
        self.least = min(sizes, default=0)
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(room + 1)]
        self.mask = 0
        self.squares = 0

    def add_bin(self, items: list[int], free: int | None = None) -> None:
        if free is None:
            free = self.room - sum(map(self.sizes.__getitem__, items))
        self.free.append(free)
        self.squares += (self.room - free) ** 2
        if free < self.least:
            # Nothing is added to it any more: packings share the list.
            self.bins.append(items)
            return
        self.bins.append(items.copy())
        self.by_free[free].append(len(self.bins) - 1)
        self.mask |= 1 << free

    def place_each(self, items: Iterable[int]) -> Packing:
        """Best fit, in the given order: into the bin with least room that is enough, or a new one."""
        sizes, room, bins, frees, by_free = self.sizes, self.room, self.bins, self.free, self.by_free
        mask, squares = self.mask, self.squares
        for item in items:
            size = sizes[item]
            fits = mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                stack = by_free[free]
                at = stack.pop()
                if not stack:
                    mask ^= 1 << free
                bins[at].append(item)
                left = frees[at] = free - size
                squares += size * (2 * (room - free) + size)
            else:
                at, left = len(bins), room - size
                bins.append([item])
                frees.append(left)
                squares += size * size
            stack = by_free[left]
            if not stack:
                mask |= 1 << left
            stack.append(at)
        self.mask, self.squares = mask, squares
        return self

    def place_all(self, items: list[int]) -> Packing:
        return self.place_each(sorted(items, key=self.sizes.__getitem__, reverse=True))

    def worth(self) -> tuple[int, float]:
        """Fewer bins are better, then bins that are full rather than even."""
        return -len(self.bins), self.squares / max(1, len(self.bins))

    def bin_of(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), dtype=np.int32)
        for number, items in enumerate(self.bins):
            out[items] = number
        return out


def from_bins(sizes: list[int], room: int, bin_of: np.ndarray) -> Packing:
    members: dict[int, list[int]] = {}
    for item, number in enumerate(bin_of.tolist()):
        members.setdefault(number, []).append(item)
    packing = Packing(sizes, room)
    for items in members.values():
        packing.add_bin(items)
    return packing


def lower_bound(sizes: np.ndarray, room: int) -> int:
    """No packing has fewer bins: by total size, and by what large items leave to middle ones."""
    best = -(-int(sizes.sum()) // room)
    large = sizes[sizes > room // 2]
    for least in np.unique(sizes[sizes <= room // 2])[:: max(1, room // 128)]:
        beside = large[large <= room - least]
        middle = int(sizes[(sizes >= least) & (sizes <= room // 2)].sum())
        best = max(best, len(large) + max(0, -(-(middle - int((room - beside).sum())) // room)))
    return max(best, len(large))


def crossover(one: Packing, other: Packing, rng: random.Random, well_filled: float) -> Packing:
    """Well-filled bins of one parent go into the other; bins with the same items go, the rest is placed anew."""
    enough = (1 - well_filled) * one.room
    chosen = [(items, free) for items, free in zip(one.bins, one.free, strict=True) if free <= enough and rng.random() < 0.5]
    child = Packing(one.sizes, one.room)
    taken = bytearray(len(one.sizes))
    for items, free in chosen:
        child.add_bin(items, free)
        for item in items:
            taken[item] = 1
    displaced = []
    for items, free in zip(other.bins, other.free, strict=True):
        here = [item for item in items if not taken[item]]
        # A half-empty bin is dissolved too: its items are what new bins are made of.
        if len(here) == len(items) and (free <= enough or rng.random() < 0.5):
            child.add_bin(items, free)
        else:
            displaced += here
    return child.place_all(displaced)


def evolve(sizes: list[int], room: int, population: list[Packing], seed: int, how: Evolution) -> list[Packing]:
    """One epoch on one island; the best packings first."""
    rng = random.Random(seed)
    bound = lower_bound(np.asarray(sizes, dtype=np.int64), room)
    if not population:
        population = [Packing(sizes, room).place_all(list(range(len(sizes))))]
    population.sort(key=Packing.worth, reverse=True)
    while len(population) < how.population and len(population[0].bins) > bound:
        start = Packing(sizes, room)
        mixed = list(range(len(sizes)))
        rng.shuffle(mixed)
        head = mixed[: len(mixed) // (2 + len(population))]
        population.append(start.place_each(head).place_all(mixed[len(head):]))
    for _ in range(how.children):
        population.sort(key=Packing.worth, reverse=True)
        if len(population[0].bins) <= bound:
            break
        one, other = rng.sample(population, 2)
        child = crossover(one, other, rng, how.well_filled)
        if child.worth() > population[-1].worth():
            population[-1] = child
    return sorted(population, key=Packing.worth, reverse=True)


def pieces_of(docs: DataFrame, path: str, end_id: int, room: int) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = words.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % room or room, n + 1, room)]
                if cuts[-1] != n:
                    cuts.append(n)
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                         for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = small_batches(docs).select(id_text(), text_or_empty().alias("text"))
    return id_number(rows.mapInPandas(run, "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"))


def pack_items(items: DataFrame, room: int, how: Evolution = Evolution()) -> DataFrame:
    """(item, length) rows shorter than the room into bins: item, shard, bin, offset."""
    spark_rows = items.select("item", F.col("length").cast("int").alias("length"))
    shards = max(1, -(-spark_rows.count() // how.shard_items))
    dealt = spark_rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    spread = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))))
    state = "shard int, island int, bins int, worth double, packing binary"

    def lengths(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        rows = rows.sort_values("item", ignore_index=True)
        return rows, rows["length"].tolist()

    def told(shard: int, island: int, best: list[Packing]) -> pd.DataFrame:
        return pd.DataFrame([
            (shard, island, len(p.bins), p.worth()[1], p.bin_of().astype("<i4").tobytes()) for p in best[: how.elites]
        ], columns=["shard", "island", "bins", "worth", "packing"])

    def first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, sizes = lengths(rows)
        return told(*key, evolve(sizes, room, [], hash(key), how))

    def later(epoch: int):
        def run(key: tuple, rows: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            _, sizes = lengths(rows)
            known = [from_bins(sizes, room, np.frombuffer(p, dtype="<i4")) for p in elites["packing"]]
            return told(*key, evolve(sizes, room, known, hash((epoch, *key)), how))

        return run

    best = spread.groupBy("shard", "island").applyInPandas(first, state)
    for epoch in range(1, how.epochs):
        # An elite stays on its island and also goes on to the next.
        homes = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(how.islands)))
        moved = best.withColumn("island", F.explode(F.array_distinct(homes)))
        best = spread.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(
            later(epoch), state)
    winner = best.groupBy("shard").agg(F.max_by("packing", F.struct(-F.col("bins"), "worth", -F.col("island"))).alias("packing"))

    def place(rows: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        rows, _ = lengths(rows)
        rows["bin"] = np.frombuffer(won["packing"].iloc[0], dtype="<i4")
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows[["item", "shard", "bin", "offset"]]

    return dealt.groupBy("shard").cogroup(winner.groupBy("shard")).applyInPandas(
        place, "item bigint, shard int, bin int, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, room: int = 1024, how: Evolution = Evolution()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of (doc_id, text)."""
    pieces = stored(pieces_of(docs, path, end_id, room).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == room)
    part = pieces.filter(F.col("length") < room)
    packed = pack_items(part, room, how)
    # Sequences of full pieces take the odd numbers, packed ones the even.
    placed = part.join(packed, "item").select(
        *_PIECE, ((F.col("shard").cast("bigint") * (1 << 20) + F.col("bin")) * 2).alias("sequence_id"), "offset")
    alone = full.select(*_PIECE, (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(alone)


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
