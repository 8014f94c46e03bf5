"""Exact nearest neighbours of vectors that have few places other than zero.

Places that few vectors have get inverted lists; places that very many have
(words of a form, say) get none. A vector is in the list of each of its rare
places, and once in a range over the length of what it has in frequent places.
A list is cut by time and size, and each cut is one unit of work, which holds
its vectors in blocks with the largest weight of a block at each rare place.
A query goes to lists of its own rare places. There the blocks are read by
decreasing bound, until the bound falls below the worst of the best found. Where
bounds leave much of a cut, as where very many vectors are equally similar, all
of it is multiplied at once, and the best are found by one whole number made of
similarity and place by id.

A query first meets the vectors that have two of its rare places in common with
it, but for pairs of places that very many vectors have. Such pairs have short
lists, and what is found there is a high bar: what was not met has one rare
place of the query, and those that make a frequent pair with it, so it is at
most as similar as the query is long there. Only a query whose bar does not
exclude that glances at the shortest of its lists, just before its own time,
for a better bar, and then goes to those lists, from the shortest on, that may
hold something. The more vectors there are, the higher is the bar, the fewer
lists and blocks are read. Vectors of many rare places have too many pairs;
there a query begins with the glance.

Vectors of one kind, which share the same with any query in a list, are equally
similar, but for those that were met in lists of pairs. They rank by id, so a
list only holds of each kind those with few smaller ids before them. Kinds grow
slower than vectors, and so do lists.

What shares no rare place with a query can only be similar through frequent
ones: at most the product of both lengths there. After the lists, a query only
goes to the ranges in which this product reaches what it has found already.
So nothing is left out, no query passes through the driver, and a vector is
copied once per rare place that it has. What all tasks know is one number per
place and one per cut, both bounded.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schemas import SPARSE
from riskweave.session import cut

MATCHES = "query_id string, id string, similarity double"

#: More than single precision can be wrong about a cosine, and rounded similarities about their order.
_MARGIN = 1e-5
_BLOCK, _FIRST_BLOCKS, _QUERIES_AT_ONCE, _NUMBERS_AT_ONCE = 8, 4, 1024, 1_000_000
# Rows read, and vectors compared, at once in lists of pairs.
_ROWS_AT_ONCE, _COMPARED_AT_ONCE = 16_384, 500_000
# Pairs of a list from which on it is multiplied as a matrix, so many pairs and numbers of it at a time.
_AS_MATRIX, _MATRIX_PAIRS, _MATRIX_NUMBERS = 256, 500_000, 1 << 22
# Blocks of a cut that set a query's first bar.
_GLANCE = 28
# With more of a cut's blocks to read than this share, all of the cut is multiplied at once, so many pairs at a time.
_MOST_READ, _PAIRS_AT_ONCE = 1 / 64, 1_000_000
# Numbers of a cut as a matrix; a larger one is always read by blocks.
_MATRIX = 1 << 24


@dataclass(frozen=True)
class ListSizes:
    """Sizes of the index. They never change a result."""

    # A place that more than this share of the vectors have is frequent.
    frequent: float = 1 / 16
    # Cuts by time, ranges over the length in frequent places; the longest are in finer ranges.
    times: int = 64
    ranges: int = 64
    finer: tuple[float, ...] = (1 - 2**-8, 1 - 2**-10, 1 - 2**-12)
    # Vectors of a cut.
    cut_vectors: int = 4096
    # A pair of places of more vectors than this part of all, and than a cut has, gets no list.
    met_share: int = 1024
    # Pairs of rare places that a vector has on average, dimensions: with more, lists of pairs are not made.
    pairs: int = 24
    dimensions: int = 4096


def is_sparse(df: DataFrame, column: str = "embedding") -> bool:
    return isinstance(df.schema[column].dataType, T.StructType)


@F.arrow_udf(SPARSE)
def as_sparse(vectors: pa.Array) -> pa.Array:
    """The places of dense vectors that are not zero."""
    offsets, flat = vectors.offsets.to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
    flat_from = offsets[0]
    at = np.flatnonzero(flat)
    row = np.searchsorted(offsets, at + flat_from, side="right") - 1
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(vectors)))]).astype(np.int32))
    places = pa.ListArray.from_arrays(ends, pa.array((at + flat_from - offsets[row]).astype(np.int32)))
    return pa.StructArray.from_arrays([places, pa.ListArray.from_arrays(ends, pa.array(flat[at].astype(np.float32)))], ["places", "weights"])


def _length(frequent: list[int]):
    """Length that a vector of length one has in frequent places."""
    known = np.array(frequent, dtype=np.int64)

    @F.arrow_udf("double")
    def length(places: pa.Array, weights: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        squares = weights.flatten().to_numpy().astype(np.float64) ** 2
        among = np.bincount(row, squares * np.isin(places.flatten().to_numpy(), known), len(places))
        whole = np.bincount(row, squares, len(places))
        return pa.array(np.sqrt(np.divide(among, whole, out=np.zeros_like(whole), where=whole > 0)))

    return length("places", "weights")


def _range_of(value: Column, bounds: list[float]) -> Column:
    """Number of the bounds below the value: from 0 to their number."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < value))


def matches(
    queries: DataFrame, candidates: DataFrame, keep: int, min_similarity: float | None = None, sizes: ListSizes = ListSizes()
) -> DataFrame:
    """`query_id, id, similarity`: candidates among which are each query's best `keep`.

    Both have `id`, `embedding` (places and weights), then columns that tell
    when a row came.
    """
    order = candidates.columns[2:]
    # Embedded once, then taken apart.
    flat = lambda df: cut(df).filter("embedding is not null").select("id", *[f"embedding.{f}" for f in SPARSE.names], *order)
    queries, candidates = flat(queries), flat(candidates)
    spark = queries.sparkSession

    # One number per place, of which there are as many as the vectors have dimensions.
    places = candidates.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    counts = {r["place"]: r["n"] for r in places.collect()}
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], MATCHES)
    frequent = sorted(p for p, c in counts.items() if c > n * sizes.frequent)
    most = max(counts, default=0) + 1
    with_length = lambda df: df.withColumn("_length", _length(frequent))
    candidates, queries = with_length(candidates), with_length(queries)
    moment = F.col(order[0]).cast("double") if order else F.lit(0.0)
    found = candidates.agg(
        F.percentile_approx(moment, [i / sizes.times for i in range(1, sizes.times)], 1000).alias("times"),
        F.percentile_approx("_length", [*(i / sizes.ranges for i in range(1, sizes.ranges)), *sizes.finer], 10_000).alias("lengths"),
        F.max("_length").alias("longest")).first()
    times = sorted(set(found["times"])) if order else []
    # The last range ends with the longest.
    lengths = sorted({*found["lengths"], found["longest"]})

    rare = lambda places: F.filter(places, lambda p: ~p.isin(frequent)) if frequent else places
    floor = -2.0 if min_similarity is None else 2 * min_similarity - 1
    queries = queries.withColumn("_floor", F.lit(floor))
    work = lambda held, asked, glance=None: _work(held, asked, order, keep, frequent, most, min_similarity, glance)
    rare_places = F.size(rare(F.col("places")))
    per_vector = candidates.agg(F.avg(rare_places * (rare_places - 1) / 2)).first()[0] or 0.0
    first, met = None, None
    if most <= sizes.dimensions and 0 < per_vector <= sizes.pairs:
        pairs = lambda df: df.withColumn("place", F.explode(_pairs_of(counts, frequent)))
        # What is left out here costs whole lists later: it grows with the number of vectors.
        most_met = max(sizes.cut_vectors, n // sizes.met_share)
        many = pairs(candidates).groupBy("place").count().filter(F.col("count") > most_met).select("place")
        met = [divmod(r["place"], most) for r in many.collect()]
        first = cut(_meet(pairs(candidates), pairs(queries), order, keep, met, most, min_similarity))
        queries = cut(_with_bars(queries, first, keep))
    unlike = candidates
    if met is not None and _no_weight_below_zero(candidates, queries):
        unlike = cut(_first_of_kinds(candidates, _kinds(counts, frequent, met), order, keep))
        in_lists = unlike.filter("place >= 0")
        sizes_of = {r["place"]: r["count"] for r in in_lists.groupBy("place").count().collect()}
        unlike = unlike.filter("place < 0").drop("place")
    else:
        in_lists, sizes_of = candidates.withColumn("place", F.explode(rare(F.col("places")))), counts
    lists = _Lists(sizes_of, times, moment, sizes.cut_vectors)
    held = lists.held(in_lists)
    needed = lambda df: cut(df.withColumn("_needed", _needed(counts, frequent, met)))
    # A list that nobody asks for is not dealt out.
    wanted = lambda asked: held.join(F.broadcast(asked.select("place", "_time").distinct()), ["place", "_time"], "left_semi")
    # A glance at one list tells which others a query needs; these are read whole.
    queries = needed(queries)
    begun = queries.filter(F.size("_needed") > 0).withColumn("place", _begin_at(counts, frequent, sizes.cut_vectors // 8))
    asked = lists.nearest(begun.filter("place is not null"))
    seen = cut(work(wanted(asked), asked, _GLANCE))
    first = seen if first is None else first.unionByName(seen)
    queries = needed(_with_bars(queries, first, keep))
    asked = lists.asked(queries.withColumn("place", F.explode("_needed")))
    first = first.unionByName(cut(work(wanted(asked), asked)))

    queries = _with_bars(queries, first, keep)
    bar = F.col("_floor") - _MARGIN
    least = F.when(F.col("_length") > 0, bar / F.col("_length") - _MARGIN).when(bar > 0, math.inf).otherwise(-math.inf)
    open_ = queries.withColumn("_least", least).filter(F.col("_least") <= lengths[-1])
    open_ = cut(open_.withColumn("place", F.explode(F.sequence(_range_of(F.col("_least"), lengths), F.lit(len(lengths) - 1)))))
    if open_.isEmpty():
        return first
    ranged = unlike.withColumn("place", F.least(_range_of(F.col("_length"), lengths), F.lit(len(lengths) - 1)))
    ranges = _Lists({r["place"]: r["count"] for r in ranged.groupBy("place").count().collect()}, times, moment, sizes.cut_vectors)
    open_ = ranges.asked(open_)
    # At most as many as there are ranges, by times.
    needed = F.broadcast(open_.select("place", "_time").distinct())
    held = ranges.held(ranged).join(needed, ["place", "_time"], "left_semi")
    return first.unionByName(work(held, open_))


def _with_bars(queries: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """Queries with the worst of what they have found as `_floor`, if they have found enough."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("similarity", "id")), asc=False), 1, keep)
    bars = found.groupBy(F.col("query_id").alias("id")).agg(best.alias("b")).filter(F.size("b") == keep).select(
        "id", F.element_at("b", -1)["similarity"].alias("_bar"))
    bar = F.greatest(2 * F.col("_bar") - 1, F.col("_floor"))
    return queries.join(bars, "id", "left").withColumn("_floor", bar).drop("_bar")


def _list_sizes(counts: dict[int, int], frequent: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that have each place, and whether it is rare; one place more than any candidate has."""
    sizes = np.zeros(max(counts, default=-1) + 2, dtype=np.int64)
    sizes[list(counts)] = list(counts.values())
    is_rare = sizes > 0
    is_rare[frequent] = False
    return sizes, is_rare


def _begin_at(counts: dict[int, int], frequent: list[int], enough: int):
    """The place of the shortest of a query's lists that has enough vectors; of the longest, if none has."""
    sizes, is_rare = _list_sizes(counts, frequent)
    worse = np.where(sizes >= enough, sizes, 2 * sizes.max() + enough - sizes)

    @F.arrow_udf("int")
    def begin_at(places: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        place = np.minimum(places.flatten().to_numpy(), len(sizes) - 1)
        row, place = row[is_rare[place]], place[is_rare[place]]
        order = np.lexsort((place, worse[place], row))
        owner, first = np.unique(row[order], return_index=True)
        out, known = np.zeros(len(places), dtype=np.int32), np.zeros(len(places), dtype=bool)
        out[owner], known[owner] = place[order][first], True
        return pa.array(out, mask=~known)

    return begin_at("places")


def _pairs_in(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number with those behind it in its row; rows are in order."""
    behind = np.searchsorted(row, row, side="right") - np.arange(len(row)) - 1
    one = np.repeat(np.arange(len(row)), behind)
    return one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(behind) - behind, behind)


def _pairs_of(counts: dict[int, int], frequent: list[int]):
    """The pairs of rare places that a vector has, as one number each."""
    sizes, is_rare = _list_sizes(counts, frequent)
    most = len(sizes) - 1

    @F.arrow_udf("array<bigint>")
    def pairs_of(places: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        place = np.minimum(places.flatten().to_numpy(), most).astype(np.int64)
        row, place = row[is_rare[place]], place[is_rare[place]]
        by_place = np.lexsort((place, row))
        row, place = row[by_place], place[by_place]
        one, other = _pairs_in(row)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[one], minlength=len(places)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place[one] * most + place[other]))

    return pairs_of("places")


def _no_weight_below_zero(*vectors: DataFrame) -> bool:
    least = [df.agg(F.min(F.array_min("weights"))).first()[0] for df in vectors]
    return all(w is None or w >= 0 for w in least)


def _mixed(numbers: np.ndarray, seed: int) -> np.ndarray:
    """Numbers that look like chance; their sums tell sets of numbers apart."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _kinds(counts: dict[int, int], frequent: list[int], unmet: list[tuple[int, int]]):
    """A vector's kind in each of its lists, as 128 bits; place -1 stands for the ranges.

    Vectors of one kind agree in what a query can share with them there: the
    frequent places, that of the list, and those that are an unmet pair with it.
    """
    sizes, is_rare = _list_sizes(counts, frequent)
    beside = np.zeros((len(sizes), len(sizes)), dtype=bool) if unmet else None
    for one, other in unmet:
        beside[one, other] = beside[other, one] = True

    @F.arrow_udf("array<struct<place: int, one: bigint, other: bigint>>")
    def kinds(places: pa.Array, weights: pa.Array) -> pa.Array:
        n = len(places)
        row = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
        place = places.flatten().to_numpy()
        weight = weights.flatten().to_numpy().astype(np.float32)
        # Equal weights are not equal parts of vectors of other lengths.
        length = np.round(np.bincount(row, weight.astype(np.float64) ** 2, n), 14).view(np.uint64)
        number = (place.astype(np.uint64) << np.uint64(32)) | weight.view(np.uint32)
        among = is_rare[place]
        near, far = _pairs_in(row[among]) if unmet else (None, None)
        if unmet:
            pair = beside[place[among][near], place[among][far]]
            near, far = near[pair], far[pair]
        found = []
        for seed in (1, 2**40 + 3):
            mixed = _mixed(number, seed)
            common = _mixed(length, seed + 1)
            np.add.at(common, row[~among], mixed[~among])
            mixed = mixed[among]
            own = common[row[among]] + _mixed(mixed, seed)
            if unmet:
                np.add.at(own, near, mixed[far])
                np.add.at(own, far, mixed[near])
            found.append(np.concatenate([common, own]).view(np.int64))
        owner = np.concatenate([np.arange(n), row[among]])
        by_owner = np.argsort(owner, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        of = np.concatenate([np.full(n, -1, dtype=np.int32), place[among].astype(np.int32)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
            [pa.array(x[by_owner]) for x in (of, *found)], names=["place", "one", "other"]))

    return kinds("places", "weights")


def _first_of_kinds(candidates: DataFrame, kinds: Column, order: list[str], keep: int) -> DataFrame:
    """Candidates with the `place` of each list, or -1, in which they can be among a query's best.

    Where `keep` of its kind came before it and have smaller ids, a vector never
    is: every query that may have it may have those, and they are as similar.
    Only what shares more with a query than its kind tells could be more
    similar; that was met in the lists of pairs. No weight may be below zero.
    """
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ["place", "one", "other"]
    rows = candidates.select("id", *order, F.explode(kinds).alias("_kind")).select(
        *[F.col(f"_kind.{c}").alias(c) for c in kind], "id", *order)
    rows = rows.repartition(tasks, *kind).sortWithinPartitions(*kind, *order, "id")
    schema = T.StructType([rows.schema[c] for c in ["place", "id", *order]])
    first = rows.mapInArrow(_first_sorted(keep, order), schema).withColumnsRenamed({c: f"_first_{c}" for c in ["id", *order]})
    same = [F.col(c).eqNullSafe(F.col(f"_first_{c}")) for c in ["id", *order]]
    return candidates.join(first, same).drop(*[f"_first_{c}" for c in ["id", *order]])


def _first_sorted(keep: int, order: list[str]):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, least = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("place", "one", "other")])
            begins = np.concatenate([[kind is None or (keys[:, 0] != kind).any()], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if batch.num_rows else []
            timeless = np.zeros(batch.num_rows, dtype=bool)
            for c in order:
                timeless |= batch.column(c).is_null().to_numpy(zero_copy_only=False)
            wanted = []
            for i, (id, begin, alone) in enumerate(zip(batch.column("id").to_pylist(), begins, timeless.tolist())):
                if begin:
                    least = []
                if alone or id is None:
                    wanted.append(i)
                elif (len(least) < keep or id < least[-1]) and id not in least:
                    insort(least, id)
                    del least[keep:]
                    wanted.append(i)
            if batch.num_rows:
                kind = keys[:, -1]
            yield batch.select(["place", "id", *order]).take(pa.array(wanted, pa.int64()))

    return first


def _needed(counts: dict[int, int], frequent: list[int], unmet: list[tuple[int, int]] | None = None):
    """The rare places whose lists a query still needs, given its bar.

    Lists are taken from the shortest on. What is in none of those taken can
    only share the places left, and is at most as similar as the query is long
    there: when that is below the bar, the other lists hold nothing new. With
    `unmet`, the query has met all vectors that have two of its rare places,
    other than these pairs: what is new in a list has no rare place but that of
    the list and those that are such a pair with it.
    """
    sizes, is_rare = _list_sizes(counts, frequent)
    if unmet is not None:
        return _needed_after_pairs(sizes, is_rare, unmet)

    @F.arrow_udf("array<int>")
    def needed(places: pa.Array, weights: pa.Array, floor: pa.Array) -> pa.Array:
        n = len(places)
        row = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
        place = np.minimum(places.flatten().to_numpy(), len(sizes) - 1)
        squares = weights.flatten().to_numpy().astype(np.float64) ** 2
        whole = np.bincount(row, squares, n)
        # Rare places first; places that no candidate has are shared with none.
        order = np.lexsort((place, sizes[place], ~is_rare[place], row))
        row, place = row[order], place[order]
        shared = np.where(sizes[place] > 0, squares[order], 0.0)
        upto = np.cumsum(shared)
        left = np.cumsum(np.bincount(row, shared, n))[row] - upto + shared
        bar = floor.to_numpy()[row] - _MARGIN
        wanted = is_rare[place] & ((bar <= 0) | (left >= (bar * bar - _MARGIN) * whole[row]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[wanted], minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place[wanted].astype(np.int32)))

    return needed("places", "weights", "_floor")


def _needed_after_pairs(sizes: np.ndarray, is_rare: np.ndarray, unmet: list[tuple[int, int]]):
    beside = np.zeros((len(sizes), len(sizes)), dtype=bool)
    for one, other in unmet:
        beside[one, other] = beside[other, one] = True

    @F.arrow_udf("array<int>")
    def needed(places: pa.Array, weights: pa.Array, floor: pa.Array) -> pa.Array:
        n = len(places)
        row = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
        place = np.minimum(places.flatten().to_numpy(), len(sizes) - 1)
        squares = weights.flatten().to_numpy().astype(np.float64) ** 2
        whole = np.bincount(row, squares, n)
        common = np.bincount(row, squares * ((sizes[place] > 0) & ~is_rare[place]), n)
        row, place, squares = (x[is_rare[place]] for x in (row, place, squares))
        order = np.lexsort((place, sizes[place], row))
        row, place, squares = row[order], place[order], squares[order]
        at = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        # One column for each rare place, the shortest lists first.
        shape = (n, int(at.max(initial=-1)) + 1)
        lists, left, taken = np.full(shape, -1), np.zeros(shape), np.zeros(shape, dtype=bool)
        lists[row, at], left[row, at] = place, squares
        bar = floor.to_numpy() - _MARGIN
        least = np.where(bar <= 0, -math.inf, (bar * bar - _MARGIN) * whole)
        for i in range(shape[1]):
            shared = left * beside[lists[:, [i]], lists] * (lists >= 0)
            shared[:, i] = left[:, i]
            taken[:, i] = (lists[:, i] >= 0) & (common + shared.sum(axis=1) >= least)
            left[taken[:, i], i] = 0.0
        ends = np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[taken].astype(np.int32)))

    return needed("places", "weights", "_floor")


def _meet(held: DataFrame, asked: DataFrame, order: list[str], keep: int, unmet: list[tuple[int, int]], dimensions: int,
          floor: float | None) -> DataFrame:
    """Matches of queries with vectors in the lists of their pairs of places; `unmet` pairs are left out."""
    columns = ["place", "id", "places", "weights", "_length", "_floor", *order]
    rows = held.withColumn("_floor", F.lit(0.0)).select(*columns, F.lit(0).alias("_kind")).unionByName(
        asked.select(*columns, F.lit(1).alias("_kind")))
    if unmet:
        many = held.sparkSession.createDataFrame([(a * dimensions + b,) for a, b in unmet], "place bigint")
        rows = rows.join(F.broadcast(many), "place", "left_anti")
    # A row without a time comes neither before nor after another.
    for name in order:
        rows = rows.filter(F.col(name).isNotNull())
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A query comes behind those that it can match.
    behind = [*order, "id", "_kind"] if order else ["_kind"]
    rows = rows.repartition(tasks, "place").sortWithinPartitions("place", *behind)
    return rows.select(*columns, "_kind").mapInArrow(_meet_sorted(keep, dimensions, floor), MATCHES)


def _meet_sorted(keep: int, dimensions: int, floor: float | None):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < _ROWS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks()
            yield from _met(rows, keep, dimensions, floor)
            # The vectors of a list that goes on.
            place = rows.column("place").to_numpy()
            last = rows.slice(int(np.searchsorted(place, place[-1])))
            waiting, n = last.filter(pa.array(last.column("_kind").to_numpy() == 0)).to_batches(), 0
        if n:
            yield from _met(pa.Table.from_batches(waiting).combine_chunks(), keep, dimensions, floor)

    return meet


def _met(rows: pa.Table, keep: int, dimensions: int, floor: float | None) -> Iterator[pa.RecordBatch]:
    """Matches of each query among the vectors that stand before it in its list."""
    place, is_query = rows.column("place").to_numpy(), rows.column("_kind").to_numpy() == 1
    before = np.cumsum(~is_query)
    begin = np.concatenate([[0], before])[np.searchsorted(place, place)]
    first, count = begin[is_query], (before - begin)[is_query]
    some = np.flatnonzero(count > 0)
    if not len(some):
        return
    held = _Rows(rows.filter(pa.array(~is_query)), 0)
    asked_rows = rows.filter(pa.array(is_query)).take(pa.array(some))
    first, count = first[some], count[some]
    places, values = held.padded()
    _, id_rank = np.unique(held.ids, return_inverse=True)
    # Queries of one list stand together, those of many pairs are taken apart.
    borders = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
    large, all_asked = np.add.reduceat(count, borders[:-1]) >= _AS_MATRIX, _Rows(asked_rows, 0)
    if large.any() and np.isfinite(held.value).all() and np.isfinite(all_asked.value).all():
        for a, z in zip(borders[:-1][large], borders[1:][large]):
            yield from _met_as_matrix(held, places, values, id_rank, all_asked, a, z, first[a], count[a:z], keep, dimensions, floor)
        left = np.flatnonzero(~np.repeat(large, np.diff(borders)))
        asked_rows, first, count, some = asked_rows.take(pa.array(left)), first[left], count[left], some[left]
    upto = np.cumsum(count)
    start = 0
    while start < len(some):
        end = int(np.searchsorted(upto, upto[start] - count[start] + _COMPARED_AT_ONCE, side="right"))
        end = min(max(end, start + 1), start + _QUERIES_AT_ONCE)
        asked = _Rows(asked_rows.slice(start, end - start), 0)
        units, here = asked.dense(dimensions), count[start:end]
        query = np.repeat(np.arange(end - start), here)
        cols = np.arange(len(query)) - np.repeat(np.cumsum(here) - here - first[start:end], here)
        similarity = _similarities(units, places, values, query, cols)
        above = 2 * similarity - 1 >= asked.floor[query] - _MARGIN
        if floor is not None:
            above &= similarity > floor
        query, cols, similarity = query[above], cols[above], similarity[above]
        ranked = np.lexsort((id_rank[cols], -similarity, query))
        query, cols, similarity = query[ranked], cols[ranked], similarity[ranked]
        # An id that came several times counts once.
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (id_rank[cols[1:]] != id_rank[cols[:-1]])
        query, cols, similarity = query[new], cols[new], similarity[new]
        best = np.arange(len(query)) - np.searchsorted(query, query, side="left") < keep
        if best.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(asked.ids[query[best]]).cast(pa.string()), pa.array(held.ids[cols[best]]).cast(pa.string()),
                pa.array(similarity[best], pa.float64())], names=["query_id", "id", "similarity"])
        start = end


def _met_as_matrix(held: _Rows, places: np.ndarray, values: np.ndarray, id_rank: np.ndarray, asked: _Rows, begin: int, end: int,
                   first: int, count: np.ndarray, keep: int, dimensions: int, floor: float | None) -> Iterator[pa.RecordBatch]:
    """Matches of the queries of one list, which stand in the order of how many of its vectors come before them."""
    step = max(keep, _MATRIX_NUMBERS // dimensions)
    for start in range(0, int(count.max()), step):
        rows = np.arange(first + start, first + min(start + step, int(count.max())))
        matrix = np.zeros((len(rows), dimensions))
        np.add.at(matrix, (np.arange(len(rows))[:, None], places[rows]), values[rows])
        # Of an id that came several times the first.
        again = np.ones(len(rows), dtype=bool)
        again[np.unique(id_rank[rows], return_index=True)[1]] = False
        by_id = np.argsort(id_rank[rows], kind="stable")
        at = int(np.searchsorted(count, start, side="right"))
        while at < len(count):
            upto = min(at + max(1, _MATRIX_PAIRS // len(rows)), len(count))
            here = np.minimum(count[at:upto] - start, len(rows))
            units = asked.dense(dimensions, begin + at, begin + upto)
            query, col = _best_of(units, matrix[:here[-1]], by_id[by_id < here[-1]], keep, again[:here[-1]], here)
            if len(query):
                cols = rows[col]
                similarity = _similarities(units, places, values, query, cols)
                above = 2 * similarity - 1 >= asked.floor[begin + at + query] - _MARGIN
                if floor is not None:
                    above &= similarity > floor
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked.ids[begin + at + query[above]]).cast(pa.string()), pa.array(held.ids[cols[above]]).cast(pa.string()),
                    pa.array(similarity[above], pa.float64())], names=["query_id", "id", "similarity"])
            at = upto


def _best_of(units: np.ndarray, matrix: np.ndarray, by_id: np.ndarray, keep: int, again: np.ndarray | None = None,
             before: np.ndarray | None = None, came: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and of their best `keep` vectors: by rounded similarity, then by id.

    A query meets the first so many vectors (`before`) or those that `came`.
    Similarity and place by id are one whole number, so that very many equally
    similar vectors cost no more than others.
    """
    m = len(matrix)
    key = units @ matrix.T
    np.clip(key, -1.0, 1.0, out=key)
    key += 1.0
    key *= 0.5e9
    np.rint(key, out=key)
    # Below 2**53, and exact.
    key *= m
    place = np.empty(m)
    place[by_id] = np.arange(m - 1, -1, -1)
    key += place
    if again is not None:
        key[:, again] = -1.0
    if before is not None:
        key[np.arange(m) >= before[:, None]] = -1.0
    if came is not None:
        key[~came] = -1.0
    if m > keep:
        key = np.partition(key, m - keep, axis=1)[:, m - keep:]
    query, at = np.nonzero(key >= 0.0)
    return query, by_id[m - 1 - np.remainder(key[query, at], m).astype(np.int64)]


def _similarities(units: np.ndarray, places: np.ndarray, values: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    step = max(1, _NUMBERS_AT_ONCE // places.shape[1])
    cosine = [np.einsum("ij,ij->i", units[rows[i:i + step, None], places[cols[i:i + step]]], values[cols[i:i + step]])
              for i in range(0, len(rows), step)]
    return np.round((1.0 + np.clip(np.concatenate(cosine), -1.0, 1.0)) / 2.0, 9)


class _Lists:
    """Lists in cuts of bounded size: one of several cuts is cut by time, one too long for that also by id."""

    def __init__(self, counts: dict[int, int], times: list[float], moment: Column, cut_vectors: int):
        self.moments = len(times) + 1
        self.moment = _range_of(moment, times)
        by_time = {p: min(self.moments, math.ceil(c / cut_vectors)) for p, c in counts.items()}
        by_id = {p: math.ceil(c / cut_vectors / by_time[p]) for p, c in counts.items()}
        known = lambda numbers: F.coalesce(
            F.get(F.array(*[F.lit(numbers.get(p, 1)) for p in range(max(numbers, default=0) + 1)]), F.col("place")), F.lit(1))
        self.by_time, self.by_id = known(by_time), known(by_id)
        self.cut = F.floor(self.moment * self.by_time / self.moments).cast("int")

    def held(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_time", self.cut).withColumn("_part", F.pmod(F.xxhash64("id"), self.by_id).cast("int"))

    def nearest(self, rows: DataFrame) -> DataFrame:
        """A query for the two cuts that end last before it, one part of each."""
        return rows.withColumn("_time", F.explode(F.sequence(F.greatest(self.cut - 1, F.lit(0)), self.cut))).withColumn(
            "_part", F.pmod(F.xxhash64("id"), self.by_id).cast("int"))

    def asked(self, rows: DataFrame) -> DataFrame:
        """A query for every cut that does not come after it."""
        return rows.withColumn("_time", F.explode(F.sequence(F.lit(0), self.cut))).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), self.by_id - 1)))


_UNIT = ["place", "_time", "_part"]


def _work(held: DataFrame, asked: DataFrame, order: list[str], keep: int, frequent: list[int], dimensions: int, floor: float | None,
          glance: int | None = None) -> DataFrame:
    """Matches of queries with the vectors of the same unit: vectors come first, queries stream past them."""
    columns = [*_UNIT, "id", "places", "weights", "_length", "_floor", *order]
    held = held.withColumn("_floor", F.lit(0.0))
    # A list that nobody asks for is not built.
    rows = held.select(*columns, F.lit(0).alias("_kind")).unionByName(asked.select(*columns, F.lit(1).alias("_kind")))
    # The number is given: by bytes, adaptive execution would deal this work to few tasks.
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(tasks, *_UNIT).sortWithinPartitions(*_UNIT, "_kind")
    return sorted_.mapInArrow(_scan(len(order), keep, frequent, dimensions, floor, glance), MATCHES)


def _scan(times: int, keep: int, frequent: list[int], dimensions: int, floor: float | None, glance: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*_UNIT, "_kind"]])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *ends], [*ends, batch.num_rows]):
                if a == z:
                    continue
                now, part = tuple(keys[:3, a]), batch.slice(a, z - a)
                if now != unit:
                    unit, waiting, index = now, [], None
                if keys[3, a] == 0:
                    waiting.append(part)
                    continue
                if index is None and waiting:
                    index = _Cut(pa.Table.from_batches(waiting), times, frequent, dimensions)
                    waiting = []
                if index is not None:
                    for start in range(0, part.num_rows, _QUERIES_AT_ONCE):
                        yield from index.best(part.slice(start, _QUERIES_AT_ONCE), keep, floor, glance)

    return scan


def _strings(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as bytes of one width, which sort as the ids do and quicker than objects."""
    return np.array(column.cast(pa.binary()).to_pylist(), dtype="S")


class _Rows:
    """Vectors of a table: where the numbers of each stand, as units of length one. Zero vectors have none."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, times: int):
        self.ids = _strings(rows.column("id"))
        self.order = [rows.column(n).to_numpy() for n in rows.schema.names[8:8 + times]] if times else []
        self.floor = rows.column("_floor").to_numpy()
        self.length = rows.column("_length").to_numpy()
        places, weights = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column("places"), rows.column("weights")))
        self.row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        self.place, values = places.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.float64)
        norms = np.sqrt(np.bincount(self.row, values * values, len(places)))
        self.value = values / norms[self.row]

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of one width; what is too short ends in zeros."""
        of_row = np.bincount(self.row, minlength=len(self.ids))
        column = np.arange(len(self.row)) - (np.cumsum(of_row) - of_row)[self.row]
        places = np.zeros((len(self.ids), max(1, of_row.max(initial=0))), dtype=np.int32)
        values = np.zeros(places.shape)
        places[self.row, column], values[self.row, column] = self.place, self.value
        return places, values

    def dense(self, dimensions: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """These rows as a matrix; places beyond the last of any candidate are left out."""
        end = len(self.ids) if end is None else end
        a, z = np.searchsorted(self.row, [begin, end])
        row, place, value = self.row[a:z] - begin, self.place[a:z], self.value[a:z]
        inside = place < dimensions
        out = np.zeros((end - begin, dimensions))
        out[row[inside], place[inside]] = value[inside]
        return out


class _Cut:
    """The vectors of one cut of a list, in blocks."""

    def __init__(self, rows: pa.Table, times: int, frequent: list[int], dimensions: int):
        self.dimensions, self.times = dimensions, times
        read = _Rows(rows, times)
        is_rare = np.ones(dimensions, dtype=bool)
        is_rare[[p for p in frequent if p < dimensions]] = False
        self.rare = np.flatnonzero(is_rare)

        places, values = read.padded()
        # Similar vectors stand together: by the rare places that fewest of these vectors have.
        seldom = np.full(dimensions, dimensions)
        among = np.argsort(np.bincount(read.place, minlength=dimensions), kind="stable")
        seldom[among[is_rare[among]]] = np.arange(len(self.rare))
        rank = np.sort(np.where(values != 0, seldom[places], dimensions), axis=1)[:, :3]
        # Of an id that came several times the first.
        first = np.lexsort((*read.order[::-1], read.ids))
        first = first[np.concatenate([[True], read.ids[first][1:] != read.ids[first][:-1]])]
        first = first[np.lexsort(rank[first].T[::-1])]
        self.ids, self.order = read.ids[first], [o[first] for o in read.order]
        self.id_rank = np.argsort(np.argsort(self.ids))
        self.matrix = None
        self.places, self.values = places[first], values[first]

        block = np.arange(len(first)) // _BLOCK
        self.blocks = -(-len(first) // _BLOCK)
        tops = np.zeros((self.blocks, dimensions), dtype=np.float32)
        np.maximum.at(tops, (np.repeat(block, places.shape[1]), self.places.ravel()), np.abs(self.values).ravel().astype(np.float32))
        self.tops = np.ascontiguousarray(tops[:, self.rare].T)
        self.lengths = np.maximum.reduceat(read.length[first], np.arange(0, len(first), _BLOCK)).astype(np.float32)

    def came(self, asked: _Rows, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Whether candidates do not come after queries; ids are only compared at equal times."""
        before, same = np.zeros(len(rows), dtype=bool), np.ones(len(rows), dtype=bool)
        for mine, held in zip(asked.order, self.order):
            before |= same & (held[cols] < mine[rows])
            same &= held[cols] == mine[rows]
        before[same] = self.ids[cols[same]] <= asked.ids[rows[same]]
        return before

    def similarities(self, units: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return _similarities(units, self.places, self.values, rows, cols)

    def best(self, batch: pa.RecordBatch, keep: int, floor: float | None, glance: int | None = None) -> Iterator[pa.RecordBatch]:
        """The best candidates of each query of the batch: blocks by decreasing bound, a few at first, then twice as many each time.

        With `glance`, only those of as many blocks.
        """
        asked = _Rows(batch, self.times)
        units, n = asked.dense(self.dimensions), len(asked.ids)
        bounds = np.abs(units[:, self.rare]).astype(np.float32) @ self.tops
        bounds += np.outer(asked.length.astype(np.float32), self.lengths)
        bar = asked.floor.copy()
        if glance is not None and glance < self.blocks:
            block = np.argpartition(-bounds, glance, axis=1)[:, :glance].ravel()
            query = np.repeat(np.arange(n), glance)
        else:
            wanted = bounds >= (bar - _MARGIN)[:, None]
            much = wanted.mean(axis=1) > _MOST_READ
            if much.any() and len(self.ids) * self.dimensions <= _MATRIX and np.isfinite(self.values).all() and np.isfinite(units).all():
                yield from self._best_of_all(asked, units, bar, np.flatnonzero(much), keep, floor)
                wanted[much] = False
            query, block = np.nonzero(wanted)
        bound = bounds[query, block]
        by_bound = np.lexsort((-bound, query))
        query, block, bound = query[by_bound], block[by_bound], bound[by_bound]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        rows, cols, similarity = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        upto, step = _FIRST_BLOCKS, _FIRST_BLOCKS
        while len(query):
            now = rank < upto
            some, c = query[now], (block[now][:, None] * _BLOCK + np.arange(_BLOCK)).ravel()
            if not len(some):
                break
            r = np.repeat(some, _BLOCK)
            there = c < len(self.ids)
            r, c = r[there], c[there]
            if self.times:
                came = self.came(asked, r, c)
                r, c = r[came], c[came]
            if len(r):
                s = self.similarities(units, r, c)
                above = (2 * s - 1 >= bar[r] - _MARGIN) & (True if floor is None else s > floor)
                rows, cols, similarity = (np.concatenate(x) for x in ((rows, r[above]), (cols, c[above]), (similarity, s[above])))
                rows, cols, similarity, place = self._ranked(rows, cols, similarity, keep)
                last = place == keep - 1
                bar[rows[last]] = np.maximum(bar[rows[last]], 2 * similarity[last] - 1)
            later = ~now & (bound >= (bar - _MARGIN)[query])
            query, block, bound, rank = query[later], block[later], bound[later], rank[later]
            step *= 2
            upto += step
        if len(rows):
            yield self._found(asked, rows, cols, similarity)

    def _ranked(self, rows: np.ndarray, cols: np.ndarray, similarity: np.ndarray, keep: int) -> tuple:
        """The best `keep` of each query, and their places."""
        ranked = np.lexsort((self.id_rank[cols], -similarity, rows))
        place = np.arange(len(rows)) - np.searchsorted(rows[ranked], rows[ranked], side="left")
        ranked, place = ranked[place < keep], place[place < keep]
        return rows[ranked], cols[ranked], similarity[ranked], place

    def _found(self, asked: _Rows, rows: np.ndarray, cols: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(asked.ids[rows]).cast(pa.string()), pa.array(self.ids[cols]).cast(pa.string()), pa.array(similarity, pa.float64())],
            names=["query_id", "id", "similarity"])

    def _best_of_all(self, asked: _Rows, units: np.ndarray, bar: np.ndarray, queries: np.ndarray, keep: int,
                     floor: float | None) -> Iterator[pa.RecordBatch]:
        """The best candidates of these queries, of all blocks."""
        m = len(self.ids)
        if self.matrix is None:
            self.matrix = np.zeros((m, self.dimensions))
            np.add.at(self.matrix, (np.arange(m)[:, None], self.places), self.values)
            self.by_id = np.argsort(self.id_rank)
        place, upto = self.times_of(asked)
        step = max(1, _PAIRS_AT_ONCE // m)
        for start in range(0, len(queries), step):
            some = queries[start:start + step]
            r, c = _best_of(units[some], self.matrix, self.by_id, keep, came=place < upto[some][:, None] if self.times else None)
            r = some[r]
            similarity = self.similarities(units, r, c) if len(r) else np.empty(0)
            above = (2 * similarity - 1 >= bar[r] - _MARGIN) & (True if floor is None else similarity > floor)
            if above.any():
                yield self._found(asked, r[above], c[above], similarity[above])

    def times_of(self, asked: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """Places of candidates in the order in which they came, and how many of them do not come after each query."""
        m, n = len(self.ids), len(asked.ids)
        if not self.times:
            return np.zeros(m, dtype=np.int64), np.full(n, m)
        # A row without a time comes neither before nor after another.
        mine = [np.where(np.isnan(o), -np.inf, o) if o.dtype.kind == "f" else o for o in asked.order]
        kind = np.arange(m + n) >= m
        line = np.lexsort((kind, np.concatenate([self.ids, asked.ids]), *[np.concatenate(o) for o in zip(self.order, mine)][::-1]))
        before = np.empty(m + n, dtype=np.int64)
        before[line] = np.cumsum(line < m)
        return before[:m] - 1, before[m:]
