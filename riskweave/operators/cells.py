"""Exact nearest neighbours of dense vectors, by cells around pivots.

A bounded number of vectors are pivots. Every candidate is in the cell of the
pivot that it makes the smallest angle with, and there in a ring: angles to the
pivot are the sorted key of a cell. A vector within an angle of a query cannot
differ from it by more than that angle in the angle to any pivot, so a query
only meets the rings that the triangle inequality leaves, in cells whose pivot
is not farther from the query than the nearest by more than twice that angle. A
search for the k nearest first looks at the query's own cell; what it finds there
is the angle for all others. Rings of many vectors are cut by id; cuts grow with
the number of vectors, so that a query goes to a bounded number of them.

Vectors that come again and again are not compared one by one. Vectors with
about the same angles to the first pivots stand together, and a query passes
them first, in order of time. If as many as it asks for are its equals, and none
beyond a border of those angles can be, it has the best there are and goes no
further. So the queries that go to cells grow with the different vectors rather
than with their copies.

Every candidate is shuffled once in each of the three steps, a query once per ring
that it meets. All that the driver learns are the pivots and two angles
and a count for each ring, whatever the number of vectors.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.session import cut

MATCHES = "query_id string, id string, similarity double"

PIVOTS, PIVOTS_FROM, RINGS, QUERIES_AT_ONCE = 32, 1024, 32, 2048
# A query goes at most to about as many cuts, until a cut has as many vectors as a task can well hold.
MOST_CUTS, MOST_VECTORS = 256, 1 << 15
_PAIRS_AT_ONCE = 4_000_000
# Candidates that set the bar, pairs that are computed exactly at once.
_FIRST, _EXACT = 1024, 20_000
# More than single precision can be wrong about a cosine.
_MARGIN = 1e-5
#: More than single precision and rounding can be wrong about an angle.
MARGIN = 2e-4
# Pivots whose angles, in steps, tell which vectors stand together; different vectors of such a group that are remembered.
_KEY_PIVOTS, _KEY_STEP, _KINDS = 10, 0.05, 64

_UNIT = ["_cell", "_ring", "_part"]


def _near(pivots: np.ndarray, dimensions: int, angles: bool):
    """Nearest pivot and the angle to it, key of the angles to the first pivots, whether all equals have that key; all angles if asked."""
    @F.arrow_udf("struct<angles: array<float>, cell: int, angle: float, key: bigint, sure: boolean>")
    def near(ids: pa.Array, vectors: pa.Array) -> pa.Array:
        rows = _unit(pa.RecordBatch.from_arrays([ids, vectors], names=["id", "embedding"]), dimensions)
        found = np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0)).astype(np.float32)
        # Not a number is the largest, as Spark has it.
        known = np.where(np.isnan(found), np.float32(2 * math.pi), found)
        cell = known.argmin(axis=1)
        steps = known[:, :_KEY_PIVOTS].astype(np.float64)
        # No angle is below zero, where copies of pivots are.
        low, high = np.floor(np.maximum(steps - MARGIN, 0.0) / _KEY_STEP), np.floor((steps + MARGIN) / _KEY_STEP)
        key = (np.floor(steps / _KEY_STEP).astype(np.int64) * (1 << 6) ** np.arange(steps.shape[1], dtype=np.int64)).sum(axis=1)
        told = found if angles else found[:, :0]
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * told.shape[1])
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(ends, pa.array(told.ravel())), pa.array(cell.astype(np.int32)),
            pa.array(found[np.arange(len(found)), cell]), pa.array(key), pa.array((low == high).all(axis=1))],
            names=["angles", "cell", "angle", "key", "sure"])

    return near("id", "embedding")


def _far_apart(units: np.ndarray, most: int) -> np.ndarray:
    """Vectors of which each is the farthest from those before it."""
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(most, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def matches(queries: DataFrame, candidates: DataFrame, keep: int, min_similarity: float | None = None, cut_vectors: int = 2048) -> DataFrame:
    """`query_id, id, similarity`: candidates among which are each query's best `keep`.

    Both have `id`, `embedding`, then columns that tell when a row came.
    """
    order = candidates.columns[2:]
    known = lambda df: df.filter("embedding is not null")
    queries, candidates = known(queries), known(cut(candidates))
    spark = queries.sparkSession
    one, n = queries.select("embedding").limit(1).toArrow(), candidates.count()
    if not one.num_rows or not n:
        return spark.createDataFrame([], MATCHES)
    dimensions = len(one.column("embedding")[0])
    reach = math.pi if min_similarity is None else math.acos(max(-1.0, min(1.0, 2 * min_similarity - 1))) + MARGIN
    # Were cuts of one size at any number of vectors, the copies of queries would grow with its square.
    cut_vectors = max(cut_vectors, min(MOST_VECTORS, math.ceil(n / MOST_CUTS)))
    if n <= cut_vectors:
        # One cut: all of it meets a share of the queries in each task.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        alone = {"_cell": F.lit(0), "_ring": F.lit(0)}
        held = candidates.withColumns(alone | {"_part": F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))})
        asked = queries.withColumns(alone | {"_part": F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int"), "_reach": F.lit(reach)})
        return _work(held, asked, order, keep, dimensions, min_similarity)

    # The choice of pivots changes the work, not the result; a bounded number of vectors will do to choose from.
    # Cells and rings smaller than a cut would only copy queries.
    some = candidates.orderBy(F.xxhash64("id"), "id").limit(PIVOTS_FROM).select("id", "embedding").toArrow()
    pivots = _far_apart(_unit(some, dimensions), min(PIVOTS, math.ceil(n / cut_vectors)))

    # Each vector's own cell, and its angle to that pivot.
    near = lambda df, angles: df.withColumn("_near", _near(pivots, dimensions, angles)).select(
        "*", F.col("_near.key").alias("_key"), F.col("_near.cell").alias("_cell"), F.col("_near.angle").alias("_angle"),
        F.col("_near.sure").alias("_sure"), F.col("_near.angles").alias("_angles")).drop("_near")
    held = cut(near(candidates, False).drop("_sure", "_angles"))
    queries = near(queries, True).withColumnsRenamed({"_cell": "_home"}).drop("_angle")
    if min_similarity is None or min_similarity < 1.0:
        queries = cut(_equals(queries, held, order, keep, dimensions))
        equals = queries.select(F.col("id").alias("query_id"), F.explode("_equals").alias("id"), F.lit(1.0).alias("similarity"))
        queries = queries.filter(~F.col("_settled"))
    else:
        queries, equals = cut(queries.withColumn("_equals", F.array().cast("array<string>"))), spark.createDataFrame([], MATCHES)
    # Who has enough equals only looks for others.
    queries = queries.withColumn("_reach", F.when(F.size("_equals") == keep, F.lit(MARGIN)).otherwise(F.lit(reach)))
    queries = queries.drop("_key", "_sure", "_settled", "_equals")
    held = held.drop("_key")
    fine = {r["_cell"]: (r["b"], min(RINGS, math.ceil(r["n"] / cut_vectors))) for r in held.groupBy("_cell").agg(
        F.percentile_approx("_angle", [i / RINGS for i in range(1, RINGS)], 1000).alias("b"), F.count("*").alias("n")).collect()}
    bounds = {c: sorted({b[RINGS * i // n - 1] for i in range(1, n)}) for c, (b, n) in fine.items()}
    per_cell = F.array(*[F.array(*[F.lit(float(b)) for b in bounds.get(c, [])]).cast("array<double>") for c in range(len(pivots))])
    held = held.withColumn("_ring", F.size(F.filter(F.get(per_cell, F.col("_cell")), lambda b: b < F.col("_angle"))))
    rings = held.groupBy("_cell", "_ring").agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count("*").alias("n")).collect()
    listed = F.array(*[F.struct(
        F.lit(r["_cell"]).alias("_cell"), F.lit(r["_ring"]).alias("_ring"), F.lit(float(r["low"])).alias("low"), F.lit(float(r["high"])).alias("high"),
        F.lit(math.ceil(r["n"] / cut_vectors)).alias("parts")) for r in rings])
    parts = {(r["_cell"], r["_ring"]): math.ceil(r["n"] / cut_vectors) for r in rings}
    most = max(r["_ring"] for r in rings) + 1
    of_ring = F.array(*[F.lit(parts.get((c, r), 1)) for c in range(len(pivots)) for r in range(most)])
    held = held.withColumn("_part", F.pmod(F.xxhash64("id"), F.get(of_ring, F.col("_cell") * most + F.col("_ring"))).cast("int"))

    def meet(asked: DataFrame, allowed) -> DataFrame:
        """Queries, once per cut of each allowed ring."""
        met = asked.withColumn("_met", F.explode(F.filter(listed, allowed)))
        return met.select("*", "_met._cell", "_met._ring", F.explode(F.sequence(F.lit(0), F.col("_met.parts") - 1)).alias("_part")).drop("_met", "_angles", "_home")

    if min_similarity is not None:
        # The radius is the angle.
        return equals.unionByName(_work(held, meet(queries, _within), order, keep, dimensions, min_similarity))
    home = meet(queries, lambda r: (r["_cell"] == F.col("_home")) & _within(r))
    first = equals.unionByName(cut(_work(held, home, order, keep, dimensions, None)))
    best = F.slice(F.sort_array(F.collect_set(F.struct("similarity", "id")), asc=False), 1, keep)
    bars = first.groupBy(F.col("query_id").alias("id")).agg(best.alias("b")).filter(F.size("b") == keep).select(
        "id", (F.acos(F.greatest(F.lit(-1.0), 2 * F.element_at("b", -1)["similarity"] - 1)) + MARGIN).alias("_bar"))
    rest = queries.join(bars, "id", "left").withColumn("_reach", F.coalesce("_bar", "_reach")).drop("_bar")
    rest = meet(rest, lambda r: (r["_cell"] != F.col("_home")) & _within(r))
    return first.unionByName(_work(held, rest, order, keep, dimensions, None))


def _within(ring):
    """Whether a ring may hold a vector within the reach of a query."""
    angle = F.get("_angles", ring["_cell"])
    # A vector of another cell is nearer to that pivot than to the query's own.
    nearer = angle - 2 * F.col("_reach") <= F.get("_angles", F.col("_home"))
    return nearer & (angle - F.col("_reach") <= ring["high"]) & (angle + F.col("_reach") >= ring["low"])


def _equals(queries: DataFrame, held: DataFrame, order: list[str], keep: int, dimensions: int) -> DataFrame:
    """Queries with `_equals`, up to `keep` ids of similarity one among vectors of the same key, and `_settled`: these are the best there are."""
    columns = ["_key", "id", "embedding", *order]
    own = [c for c in queries.columns if c not in columns]
    rows = queries.withColumn("_kind", F.lit(1)).unionByName(held.select(*columns, F.lit(0).alias("_kind")), allowMissingColumns=True)
    # A row without a time comes neither before nor after another.
    for name in order:
        rows = rows.filter(F.col(name).isNotNull())
    # A query comes behind those that it can match.
    behind = [*order, "id", "_kind"] if order else ["_kind"]
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select(*columns, *own, "_kind").repartition(tasks, "_key").sortWithinPartitions("_key", *behind)
    told = sorted_.drop("_kind").schema.add("_equals", T.ArrayType(T.StringType())).add("_settled", T.BooleanType())
    return sorted_.mapInArrow(_pass_equals(keep, dimensions), told)


def _pass_equals(keep: int, dimensions: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            units = _unit(batch.select(["id", "embedding"]), dimensions)
            raw = units.view(np.dtype((np.void, units.itemsize * dimensions))).ravel().tolist()
            kinds, sure = (batch.column(c).to_pylist() for c in ("_kind", "_sure"))
            rows, equals, settled = [], [], []
            for i, (now, id_) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                if now != key:
                    key, group = now, _Group(keep)
                if not kinds[i]:
                    group.add(raw[i], units[i], id_)
                    continue
                rows.append(i)
                equals.append(group.equals(raw[i], units[i]))
                settled.append(sure[i] and group.whole and len(equals[-1]) == keep)
            if rows:
                asked = batch.select([n for n in batch.schema.names if n != "_kind"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*asked.columns, pa.array(equals, pa.list_(pa.string())), pa.array(settled, pa.bool_())],
                    names=[*asked.schema.names, "_equals", "_settled"])

    return scan


class _Group:
    """The least ids of each different vector that came so far, of vectors that stand together."""

    def __init__(self, keep: int):
        self.keep, self.whole = keep, True
        self.kinds: dict[bytes, list] = {}
        self.units: list[np.ndarray] = []
        self.known: dict[bytes, tuple[int, list]] = {}

    def add(self, raw: bytes, unit: np.ndarray, id_: str) -> None:
        least = self.kinds.get(raw)
        if least is None:
            if len(self.kinds) == _KINDS:
                self.whole = False
                return
            least = self.kinds[raw] = []
            self.units.append(unit.copy())
        if (len(least) < self.keep or id_ < least[-1]) and id_ not in least:
            insort(least, id_)
            del least[self.keep:]

    def equals(self, raw: bytes, unit: np.ndarray) -> list:
        """The least ids among vectors of similarity one."""
        upto, lists = self.known.get(raw, (0, []))
        if upto < len(self.units):
            cosine = np.clip(np.array(self.units[upto:]) @ unit, -1.0, 1.0)
            every = list(self.kinds.values())[upto:]
            lists = lists + [every[i] for i in np.flatnonzero(np.round((1.0 + cosine) / 2.0, 9) == 1.0)]
            if raw in self.known or len(self.known) < _KINDS:
                self.known[raw] = len(self.units), lists
        if len(lists) == 1:
            return list(lists[0])
        return sorted({i for least in lists for i in least})[:self.keep]


def _work(held: DataFrame, asked: DataFrame, order: list[str], keep: int, dimensions: int, floor: float | None) -> DataFrame:
    """Matches of queries with the vectors of the same cut: vectors come first, queries stream past them."""
    columns = [*_UNIT, "id", "embedding", *order]
    rows = held.select(*columns, F.lit(0).alias("_kind"), F.lit(0.0).alias("_reach")).unionByName(
        asked.select(*columns, F.lit(1).alias("_kind"), F.col("_reach").cast("double").alias("_reach")))
    # The number is given: by bytes, adaptive execution would deal this work to few tasks.
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *_UNIT).sortWithinPartitions(*_UNIT, "_kind").mapInArrow(_scan(len(order), keep, dimensions, floor), MATCHES)


def _scan(times: int, keep: int, dimensions: int, floor: float | None):
    def read(rows) -> tuple:
        slim = rows.select(["id", "embedding", *rows.schema.names[5:5 + times]])
        return _ids(slim.column("id")), _unit(slim, dimensions), [slim.column(n).to_numpy() for n in slim.schema.names[2:]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*_UNIT, "_kind"]])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *ends], [*ends, batch.num_rows]):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if tuple(keys[:3, a]) != unit:
                    unit, waiting, held = tuple(keys[:3, a]), [], None
                if keys[3, a] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    held, waiting = read(pa.Table.from_batches(waiting)), []
                for start in range(0, part.num_rows if held else 0, QUERIES_AT_ONCE):
                    some = part.slice(start, QUERIES_AT_ONCE)
                    asked = read(some)
                    query, ids, similarity = _best(asked, *held, keep, floor)
                    reach = some.column("_reach").to_numpy()[query]
                    near = np.arccos(np.clip(2 * similarity - 1, -1.0, 1.0)) <= reach + MARGIN
                    yield from _as_table(asked[0], query[near], ids[near], similarity[near]).to_batches(max_chunksize=10_000)

    return scan


# ---- arithmetic inside one task ---------------------------------------------

def _unit(vectors: pa.Table | pa.RecordBatch, dimensions: int) -> np.ndarray:
    """The embeddings as a matrix of unit rows; zero vectors stay zero."""
    column = vectors.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dimensions).any():
        wrong = min(np.flatnonzero(lengths != dimensions).tolist(), key=lambda i: vectors.column("id")[i].as_py())
        raise ValueError(f"vector of {vectors.column('id')[wrong]} has {lengths[wrong]} numbers, not {dimensions}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _order(vectors: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """The columns behind the embedding: when a row came."""
    return [vectors.column(n).to_numpy() for n in vectors.schema.names[2:]]


def _came(query: tuple, rows: np.ndarray, ids: np.ndarray, order: list, cols: np.ndarray) -> np.ndarray:
    """Whether candidates do not come after queries, for pairs of places; ids are only compared at equal times."""
    shape = np.broadcast_shapes(rows.shape, cols.shape)
    before, same = np.zeros(shape, dtype=bool), np.ones(shape, dtype=bool)
    for asked, held in zip(query[2], order):
        before |= same & (held[cols] < asked[rows])
        same &= held[cols] == asked[rows]
    ties = np.nonzero(same)
    before[ties] = ids[np.broadcast_to(cols, shape)[ties]] <= query[0][np.broadcast_to(rows, shape)[ties]]
    return before


def _not_after(last: list, order: list) -> int:
    """Number of candidates, in order of time, whose time is not after the last."""
    before, same = np.zeros(len(order[0]), dtype=bool), np.ones(len(order[0]), dtype=bool)
    for asked, held in zip(last, order):
        before |= same & (held < asked)
        same &= held == asked
    return int((before | same).sum())


def _fewer_copies(ids: np.ndarray, units: np.ndarray, order: list, keep: int):
    """Each id once, sorted; without an order at most `keep` ids with one vector: further ones always rank behind."""
    ids, first = np.unique(ids, return_index=True)
    units, order = np.ascontiguousarray(units[first]), [o[first] for o in order]
    if order:
        return ids, units, order
    _, group = np.unique(units.view(np.dtype((np.void, units.itemsize * units.shape[1]))).ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], group[by_group], side="left")
    kept = np.sort(by_group[np.arange(len(group)) - starts < keep])
    return ids[kept], units[kept], []


def _first_per_query(query: np.ndarray, similarity: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the best `keep` entries of every query number, repeated ids left out."""
    order = np.lexsort((ids, -similarity, query))
    if len(order):
        same = (query[order][1:] == query[order][:-1]) & (ids[order][1:] == ids[order][:-1])
        order = order[np.concatenate([[True], ~same])]
    sorted_query = query[order]
    starts = np.searchsorted(sorted_query, sorted_query, side="left")
    return order[np.arange(len(order)) - starts < keep]


def _best(query: tuple, ids: np.ndarray, units: np.ndarray, order: list, keep: int, floor: float | None):
    """Query numbers, candidate ids and similarities of the best pairs of one block.

    Single precision tells which pairs may be among the best; only these are
    computed in double precision. The bar comes from the first candidates.
    """
    ids, units, order = _fewer_copies(ids, units, order, keep)
    every = np.arange(len(query[1]))
    if order:
        # Both sides by time, so that queries leave out the candidates after them.
        by_time = np.lexsort(order[::-1])
        ids, units, order = ids[by_time], units[by_time], [o[by_time] for o in order]
        every = np.lexsort(query[2][::-1])
    single = units.astype(np.float32)
    found = []
    step = max(1, _PAIRS_AT_ONCE // max(1, len(ids)))
    for start in range(0, len(every), step):
        numbers = every[start:start + step]
        upto = len(ids)
        if order:
            upto = _not_after([o[numbers[-1]] for o in query[2]], order)
        first = np.arange(min(upto, _FIRST))
        cosine = query[1][numbers].astype(np.float32) @ single[:upto].T
        bar = np.full((len(numbers), 1), -2.0 if floor is None else 2.0 * floor - 1.0, dtype=np.float32)
        if len(first) > keep:
            some = cosine[:, first]
            if order:
                some[~_came(query, numbers[:, None], ids, order, first[None, :])] = -2.0
            bar = np.maximum(bar, np.partition(some, len(first) - keep, axis=1)[:, -keep][:, None])
        rows, cols = np.nonzero(cosine >= bar - np.float32(_MARGIN))
        rows = numbers[rows]
        if order:
            came = _came(query, rows, ids, order, cols)
            rows, cols = rows[came], cols[came]
        exact = np.concatenate([
            np.einsum("ij,ij->i", query[1][rows[i:i + _EXACT]], units[cols[i:i + _EXACT]])
            for i in range(0, len(rows), _EXACT)] or [np.empty(0)])
        similarity = np.round((1.0 + np.clip(exact, -1.0, 1.0)) / 2.0, 9)
        if floor is not None:
            near = similarity > floor
            rows, cols, similarity = rows[near], cols[near], similarity[near]
        best = _first_per_query(rows, similarity, ids[cols], keep)
        found.append((rows[best], ids[cols[best]], similarity[best]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _as_table(query_ids: np.ndarray, query: np.ndarray, ids: np.ndarray, similarity: np.ndarray) -> pa.Table:
    return pa.table({
        "query_id": pa.array(query_ids[query], pa.string()),
        "id": pa.array(ids, pa.string()),
        "similarity": pa.array(similarity, pa.float64()),
    })
