"""Neighbours through inverted lists, against brute force and against the dense search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.functions.embed import hash_embedding, sparse_hash_embedding
from riskweave.operators import sparse
from riskweave.operators import vectors as N

SMALL = (
    sparse.ListSizes(),
    sparse.ListSizes(frequent=0.5, times=3, ranges=4, cut_vectors=7),
    sparse.ListSizes(frequent=0.0),
    sparse.ListSizes(frequent=1.0, times=5, cut_vectors=3),
)


def counts(seed, n=160, dimensions=30):
    """Vectors of a few words: some in nearly all, most in few; copies, vectors of nothing and of one word."""
    rng = np.random.default_rng(seed)
    share = np.concatenate([[0.9, 0.8, 0.6], np.full(dimensions - 3, 0.08)])
    matrix = (rng.random((n, dimensions)) < share) * rng.integers(1, 4, (n, dimensions))
    matrix[::7] = matrix[3]
    matrix[5] = matrix[11] = 0
    matrix[13] = np.eye(dimensions)[20]
    return matrix.astype(float)


def frame(spark, matrix, times):
    rows = [(f"v{i:04d}", [float(x) for x in row], int(t)) for i, (row, t) in enumerate(zip(matrix, times))]
    dense = spark.createDataFrame(rows, "id string, embedding array<float>, at bigint")
    return dense.withColumn("embedding", sparse.as_sparse("embedding"))


def brute(matrix, times, k, asked, timed, floor=None, self_takes_slot=True):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    out = []
    for q in asked:
        similarity = np.round((1 + np.clip(unit @ unit[q], -1, 1)) / 2, 9)
        able = [c for c in range(len(unit)) if not timed or (times[c], c) <= (times[q], q)]
        best = sorted((-similarity[c], c) for c in able if (floor is None or similarity[c] > floor) and (self_takes_slot or c != q))[:k]
        out += [(f"v{q:04d}", f"v{c:04d}", -s) for s, c in best if c != q]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.id, r.similarity) for r in df.collect())


@pytest.mark.parametrize("sizes", SMALL)
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(sparse.matches, "__defaults__", (None, sizes))
    for seed, timed in ((1, True), (2, False), (3, True)):
        matrix, times = counts(seed), np.random.default_rng(seed).integers(0, 40, 160)
        rows = frame(spark, matrix, times).repartition(3)
        asked = range(0, 160, 3)
        queries = rows.filter(F.substring("id", 2, 4).cast("int") % 3 == 0)
        found = N.knn(queries, rows, 4, self_takes_slot=True, as_of=("at",) if timed else ())
        assert got(found) == brute(matrix, times, 4, asked, timed)


def test_negative_weights_radius_and_copies(spark, monkeypatch):
    matrix, times = counts(4), np.zeros(160)
    matrix[::2] *= np.random.default_rng(1).choice([-1, 1], matrix[::2].shape)
    rows = frame(spark, matrix, times)
    twice = rows.unionByName(rows)
    for sizes in SMALL:
        monkeypatch.setattr(sparse.matches, "__defaults__", (None, sizes))
        assert got(N.knn(rows, twice, 5)) == brute(matrix, times, 5, range(160), False, self_takes_slot=False)
        near = N.similar_within(rows, rows, 0.5, 10)
        assert got(near) == brute(matrix, times, 10, range(160), False, floor=0.75, self_takes_slot=False)


def test_nothing_to_search(spark):
    rows = frame(spark, counts(5, 20), np.zeros(20))
    assert N.knn(rows.limit(0), rows, 3).isEmpty() and N.knn(rows, rows.limit(0), 3).isEmpty()


def test_only_close_lists_are_read(spark):
    """Of vectors that share a form and have a few words of their own, a small part meets each query."""
    rng = np.random.default_rng(8)
    n, met = 3000, []
    matrix = np.zeros((n, 300))
    matrix[:, :6] = 1
    for row in matrix:
        row[rng.integers(6, 300, 3)] = 1
    matrix[1::2] = matrix[::2]
    rows = frame(spark, matrix, np.zeros(n))
    work = sparse._work

    def counted(held, asked, *rest):
        units = ["place", "_time", "_part"]
        size = lambda df, name: df.groupBy(*units).agg(F.count("*").alias(name))
        pairs = size(held, "h").join(size(asked, "a"), units).agg(F.sum(F.col("h") * F.col("a"))).first()[0]
        met.append(pairs or 0)
        return work(held, asked, *rest)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sparse, "_work", counted)
        found = N.knn(rows, rows, 1)
    assert found.filter("similarity < 0.999999").isEmpty() and found.count() == n
    assert sum(met) < 0.1 * n * n


def test_both_forms_of_the_embedding_are_equal(spark):
    texts = ["", None, "Groceries and fuel and fuel", "a b c d e a b a 12.50 EUR", "ünï 日本 x_1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(sparse.as_sparse(hash_embedding(F.col("t"))).alias("a"), sparse_hash_embedding(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_lists_that_a_bar_needs(spark):
    """Shortest lists first, until what is left of the query is shorter than the bar; without a bar, all rare ones."""
    counts = {0: 90, 1: 5, 2: 50, 3: 20}
    rows = spark.createDataFrame(
        [([0, 1, 2, 3, 7], [1.0] * 5, bar) for bar in (-2.0, 0.85, 0.7, 0.6)], "places array<int>, weights array<float>, _floor double")
    # The last place has no list, and the first is frequent: 4 of 5 squares are shared at most, then 3, 2 and 1.
    found = rows.select("_floor", sparse._needed(counts, [0]).alias("needed")).collect()
    assert {r["_floor"]: sorted(r.needed) for r in found} == {-2.0: [1, 2, 3], 0.85: [1], 0.7: [1, 3], 0.6: [1, 2, 3]}
    begun = rows.select(sparse._begin_at(counts, [0], 10).alias("place")).first().place
    assert begun == 3


def test_pairs_leave_no_list_to_read(spark, monkeypatch):
    """What shares two rare places is met first; a bar from there that one rare place cannot reach closes all lists."""
    rng = np.random.default_rng(9)
    n, met = 600, []
    matrix = np.zeros((n, 160))
    matrix[:, :6] = 1
    for row in matrix:
        row[rng.choice(np.arange(6, 160), 3, replace=False)] = 1
    matrix[1::2] = matrix[::2]
    rows = frame(spark, matrix, np.zeros(n))
    work = sparse._work
    monkeypatch.setattr(sparse, "_work", lambda held, asked, *rest: met.append(asked.count()) or work(held, asked, *rest))
    assert got(N.knn(rows, rows, 1)) == brute(matrix, np.zeros(n), 1, range(n), False, self_takes_slot=False)
    assert sum(met) == 0


def test_lists_needed_after_pairs(spark):
    """A list holds news only if one place, and those it makes an unmet pair with, can reach the bar."""
    counts = {0: 90, 1: 5, 2: 6, 3: 7, 4: 8}
    rows = spark.createDataFrame([([0, 1, 2, 3], [2.0, 1.0, 1.0, 1.0], 0.88)], "places array<int>, weights array<float>, _floor double")
    # Squares 4 of 7 and one more are shared at most: 0.845; with an unmet pair, two more: 0.926.
    needed = lambda unmet: sorted(rows.select(sparse._needed(counts, [0], unmet).alias("n")).first().n)
    assert needed([]) == [] and needed([(2, 3)]) == [2] and needed(None) == [1, 2]
    assert sorted(rows.select(sparse._pairs_of(counts, [0]).alias("n")).first().n) == [1 * 5 + 2, 1 * 5 + 3, 2 * 5 + 3]


def test_of_many_equally_similar_vectors_few_are_compared_exactly(monkeypatch):
    """One cut of vectors that all have one place, and others by chance, so that no bound leaves anything out."""
    rng = np.random.default_rng(4)
    matrix, times = (rng.random((600, 40)) < 0.1).astype(float), rng.integers(0, 900, 600)
    matrix[:, 7] = 1
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    rows = pa.table({
        "place": [7] * 600, "_time": [0] * 600, "_part": [0] * 600, "id": [f"v{i:04d}" for i in range(600)],
        "places": pa.array([np.flatnonzero(v).astype(np.int32) for v in matrix]),
        "weights": pa.array([v[v > 0].astype(np.float64) for v in unit]),
        "_length": [0.0] * 600, "_floor": [-2.0] * 600, "at": times})
    compared, similarities = [], sparse._similarities
    monkeypatch.setattr(sparse, "_similarities", lambda u, p, v, r, c: compared.append(len(r)) or similarities(u, p, v, r, c))
    cut = sparse._Cut(rows, 1, [], 40)
    found = [x for batch in cut.best(rows.to_batches()[0], 5, None) for x in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(x for x in found if x[0] != x[1]) == brute(matrix, times, 5, range(600), True)
    # By blocks, more than a fifth of all pairs.
    assert sum(compared) < 600 * 600 / 50


def test_of_a_long_list_of_a_pair_few_are_compared_exactly(monkeypatch):
    """The list of one pair of places, in the order of time; an id comes twice, and many vectors are equally similar."""
    rng = np.random.default_rng(6)
    matrix = (rng.random((300, 30)) < 0.1).astype(float)
    matrix[:, 3] = matrix[:, 4] = 1
    matrix[250] = matrix[7]
    ids = [f"v{i:04d}" for i in rng.permutation(300)]
    ids[250] = ids[7]
    row = lambda i, kind: {
        "place": 3 * 30 + 4, "id": ids[i], "places": np.flatnonzero(matrix[i]).astype(np.int32), "weights": matrix[i][matrix[i] > 0].astype(np.float32),
        "_length": 0.0, "_floor": -2.0 if kind else 0.0, "_kind": kind}
    rows = pa.Table.from_pylist([row(i, kind) for i in range(300) for kind in (0, 1)])
    compared, similarities = [], sparse._similarities
    monkeypatch.setattr(sparse, "_similarities", lambda u, p, v, r, c: compared.append(len(r)) or similarities(u, p, v, r, c))
    found = {x for batch in sparse._met(rows, 5, 30, None) for x in zip(*(c.to_pylist() for c in batch.columns))}
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    expected = set()
    for q in range(300):
        near = {ids[c]: np.round((1 + min(1.0, unit[q] @ unit[c])) / 2, 9) for c in range(q + 1)}
        expected |= {(ids[q], i, s) for i, s in sorted(near.items(), key=lambda x: (-x[1], x[0]))[:5]}
    assert found == expected
    assert sum(compared) <= 5 * 300


def test_lists_hold_few_of_a_kind(spark, monkeypatch):
    """Vectors of a form and two of ten words: in a word's list nearly all are of one kind, so that its first ids are enough."""
    rng = np.random.default_rng(10)
    n, keep, held = 600, 30, []
    matrix = np.zeros((n, 16))
    matrix[:, :6] = 1
    for row in matrix:
        row[rng.choice(np.arange(6, 16), 2, replace=False)] = 1
    matrix[::50, 0] = 2
    times = np.arange(n) // 3
    work = sparse._work
    monkeypatch.setattr(sparse, "_work", lambda h, *rest: held.append(h.count()) or work(h, *rest))
    monkeypatch.setattr(sparse.matches, "__defaults__", (None, sparse.ListSizes(frequent=0.25)))
    rows = frame(spark, matrix, times)
    found = N.knn(rows, rows, keep, self_takes_slot=True, as_of=("at",))
    assert got(found) == brute(matrix, times, keep, range(n), True)
    # Of each word at most so many of the form and the few others, where its list has 120.
    assert held and max(held) <= 10 * keep + 2 * n / 50 * 2
