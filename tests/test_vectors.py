"""Nearest neighbours, in large units of work and in small ones, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import cells
from riskweave.operators import vectors as N

BLOCKS = (
    RiskConfig(cut_vectors=40),
    RiskConfig(cut_vectors=7),
)


def table(spark, matrix, names=None):
    names = names or [f"v{i:04d}" for i in range(len(matrix))]
    return spark.createDataFrame(
        [(n, [float(x) for x in row]) for n, row in zip(names, matrix)], "id string, embedding array<float>")


def brute(matrix, k, self_takes_slot=False, floor=None):
    unit = matrix.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = []
    for q in range(len(unit)):
        similarity = np.round((1 + np.clip(unit @ unit[q], -1, 1)) / 2, 9)
        best = sorted((-s, c) for c, s in enumerate(similarity) if floor is None or s > floor)
        best = best[:k] if self_takes_slot else [b for b in best if b[1] != q][:k]
        out += [(f"v{q:04d}", f"v{c:04d}", -s) for s, c in best if c != q]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.id, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    """A third of the vectors are copies of one; the rest form clusters."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    matrix = centres[rng.integers(0, 6, 150)] + rng.normal(scale=0.05, size=(150, 8))
    matrix[::3] = matrix[0]
    return matrix


@pytest.mark.parametrize("cfg", (RiskConfig(), *BLOCKS))
def test_neighbours(spark, clustered, cfg):
    rows = table(spark, clustered).repartition(5)
    assert got(N.knn(rows, rows, 4, cfg)) == brute(clustered, 4)


@pytest.mark.parametrize("cfg", (RiskConfig(), BLOCKS[0]))
def test_self_can_take_a_place(spark, clustered, cfg):
    rows = table(spark, clustered)
    assert got(N.knn(rows, rows, 4, cfg, self_takes_slot=True)) == brute(clustered, 4, self_takes_slot=True)


@pytest.mark.parametrize("cfg", (RiskConfig(), BLOCKS[0], BLOCKS[1]))
def test_radius(spark, clustered, cfg):
    rows = table(spark, clustered)
    near = N.similar_within(rows, rows, 0.3, 10, cfg)
    assert got(near) == brute(clustered, 10, floor=0.85)
    assert near.filter("distance >= 0.3").isEmpty() and N.similarity_faults(near).isEmpty()


@pytest.mark.parametrize("cfg", (RiskConfig(), BLOCKS[0]))
def test_repeated_candidates_count_once(spark, clustered, cfg):
    rows = table(spark, clustered)
    assert got(N.knn(rows, rows.unionByName(rows).repartition(7), 4, cfg)) == brute(clustered, 4)


@pytest.mark.parametrize("cfg", (RiskConfig(), BLOCKS[0]))
def test_few_or_no_candidates(spark, cfg):
    rows = table(spark, np.eye(3))
    assert got(N.knn(rows, rows, 5, cfg)) == brute(np.eye(3), 5)
    assert N.knn(rows.limit(0), rows, 5, cfg).isEmpty()
    assert N.knn(rows, rows.limit(0), 5, cfg).isEmpty()


def test_ranks_start_at_one_and_follow_the_order(spark, clustered):
    rows = table(spark, clustered)
    ranks = N.knn(rows, rows, 4).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    assert {tuple(r.r) for r in ranks.collect()} == {(1, 2, 3, 4)}


def test_unknown_transactions_are_left_out_and_the_summary_counts_the_rest(spark, clustered):
    rows = table(spark, clustered)
    matches = N.knn(rows, rows, 4)
    known = rows.filter("id <> 'v0000'").select("id")
    kept = N.existing_only(matches, known)
    assert kept.filter("id = 'v0000'").isEmpty()
    assert kept.count() == matches.filter("id <> 'v0000'").count()
    summary = {r.id: r for r in N.similarity_summary(kept).collect()}
    listed = [s for q, c, s in brute(clustered, 4) if q == "v0001" and c != "v0000"]
    assert summary["v0001"].similar_count == len(listed)
    assert summary["v0001"].similar_mean == pytest.approx(sum(listed) / len(listed))


def test_built_in_embedding_ranks_by_shared_words(make):
    tx = make([
        (1, 1, 2, 0, 2000, "Quarterly piano lessons, beginners"),
        (2, 1, 3, 0, 1800, "Quarterly piano lessons, choir"),
        (3, 5, 6, 0, 150, "Spare parts of a bicycle"),
        (4, 1, 9, 0, 1900, "Quarterly piano lessons"),
    ])
    stored = N.embed_transactions(tx).cache()
    best = [r.id[-1] for r in N.knn(stored.filter("id like '%4'"), stored, 3).orderBy("rank").collect()]
    assert len(best) == 3 and set(best[:2]) == {"1", "2"}
    lengths = stored.select(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)").alias("n"), F.size("embedding").alias("d"))
    assert all(r.d == 384 and r.n == pytest.approx(1.0, abs=1e-6) for r in lengths.collect())


def test_embedding_of_empty_text_is_zero(spark):
    from riskweave.functions.embed import hash_embedding
    row = spark.createDataFrame([("",), (None,)], "t string").select(hash_embedding(F.col("t")).alias("e")).collect()
    assert all(len(r.e) == 384 and not any(r.e) for r in row)


def test_vectors_of_other_lengths_are_named(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0] * 6)], "id string, embedding array<float>")
    with pytest.raises(Exception, match="vector of b has 2 numbers, not 4"):
        N.knn(rows.filter("id = 'a'"), rows, 2).collect()


@pytest.mark.parametrize("cfg", (RiskConfig(), *BLOCKS))
def test_only_earlier_rows_match(spark, clustered, cfg):
    rng = np.random.default_rng(6)
    came = [(int(a), int(b)) for a, b in rng.integers(0, 12, (150, 2))]
    rows = table(spark, clustered).join(spark.createDataFrame(
        [(f"v{i:04d}", *c) for i, c in enumerate(came)], "id string, batch int, at bigint"), "id").repartition(4)
    unit = clustered.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = []
    for q in range(150):
        similarity = np.round((1 + np.clip(unit @ unit[q], -1, 1)) / 2, 9)
        best = sorted((-s, c) for c, s in enumerate(similarity) if (*came[c], c) <= (*came[q], q))[:4]
        expected += [(f"v{q:04d}", f"v{c:04d}", -s) for s, c in best if c != q]
    assert got(N.knn(rows, rows, 4, cfg, self_takes_slot=True, as_of=("batch", "at"))) == sorted(expected)


def test_neighbours_for_a_model_come_in_order_and_redacted(spark, make):
    from riskweave.operators.scoring import model_of
    from riskweave.plans.evaluate import neighbours

    tx = make([(1, 1, 2, 0, 20, "call 212-555-0199"), (2, 1, 3, 1, 18, "b"), (3, 5, 6, 2, 15, "c")])
    rows = N.embed_transactions(tx)
    model = model_of(lambda redacted, similar: (1.0, ""))
    row = neighbours(N.knn(rows, rows, 2), tx, model).filter("id like '%3'").first()
    assert [n.rank for n in row.similar] == [1, 2] and row.similar_count == 2
    assert "from_account" not in row.similar[0].asDict()
    assert {n.redacted_description for n in row.similar} == {"call [REDACTED_PHONE]", "b"}


def test_the_triangle_inequality_leaves_few_pairs(spark, monkeypatch):
    """Of vectors in clusters, a radius meets the cells of its own cluster, and no query more than every cut once."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 64))
    matrix = centres[rng.integers(0, 20, 2000)] + rng.normal(scale=0.1, size=(2000, 64))
    rows, met = table(spark, matrix), []
    work = cells._work

    def counted(held, asked, *rest):
        size = lambda df, name: df.groupBy(*cells._UNIT).agg(F.count("*").alias(name))
        met.append(size(held, "h").join(size(asked, "a"), cells._UNIT).agg(F.sum(F.col("h") * F.col("a"))).first()[0])
        return work(held, asked, *rest)

    monkeypatch.setattr(cells, "_work", counted)
    near = N.similar_within(rows, rows, 0.6, cfg=RiskConfig(cut_vectors=100))
    assert got(near) == brute(matrix, 10, floor=0.7)
    assert sum(met) < 0.2 * 2000 * 2000


def test_cuts_grow_with_the_vectors(spark, clustered, monkeypatch):
    """However small cuts are, a query goes to a bounded number of them."""
    met, work = [], cells._work

    def counted(held, asked, *rest):
        met.append(asked.groupBy("id").count().agg(F.max("count")).first()[0] or 0)
        return work(held, asked, *rest)

    monkeypatch.setattr(cells, "_work", counted)
    monkeypatch.setattr(cells, "MOST_CUTS", 2)
    rows = table(spark, clustered)
    assert got(N.knn(rows, rows, 4, RiskConfig(cut_vectors=3))) == brute(clustered, 4)
    assert max(met) <= 4


def test_dense_vectors_are_laid_out_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from riskweave.functions.embed import dense_units

    rows = 4000
    buckets = pa.array([[i % 384, i % 7, i % 7] for i in range(rows + 1)], pa.list_(pa.int32())).slice(1)
    tracemalloc.start()
    found = dense_units(buckets, 384)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * rows * 384 * 4
    row = found[2999].as_py()
    assert len(found) == rows and row[3000 % 384] == pytest.approx(5 ** -0.5) and row[3000 % 7] == pytest.approx(2 * 5 ** -0.5)


@pytest.mark.parametrize("floor", (None, 0.9))
def test_copies_are_not_compared_one_by_one(spark, monkeypatch, floor):
    """Six hundred vectors of which twelve differ, in any order of time; two of them are one but for their last bits."""
    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(12, 8))
    kinds[1] = kinds[0] * 3
    matrix = kinds[rng.integers(0, 12, 600)].astype(np.float32)
    at = [int(x) for x in rng.integers(0, 200, 600)]
    rows = spark.createDataFrame(
        [(f"v{i:04d}", [float(x) for x in v], at[i]) for i, v in enumerate(matrix)], "id string, embedding array<float>, at bigint")
    odd = spark.createDataFrame([("v9998", None, 1), ("v9999", [1.0] * 8, None)], rows.schema)
    met, work = [], cells._work
    monkeypatch.setattr(cells, "_work", lambda held, asked, *rest: met.append(asked.select("id").distinct().count()) or work(held, asked, *rest))
    found = got(N.knn(rows.union(odd), rows.union(odd), 5, RiskConfig(cut_vectors=40), True, floor, as_of=["at"]))
    unit = matrix.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = []
    for q in range(600):
        similarity = np.round((1 + np.clip(unit @ unit[q], -1, 1)) / 2, 9)
        came = [c for c in range(600) if (at[c], c) <= (at[q], q) and (floor is None or similarity[c] > floor)]
        best = sorted((-similarity[c], c) for c in came)[:5]
        expected += [(f"v{q:04d}", f"v{c:04d}", -s) for s, c in best if c != q]
    assert found == sorted(expected)
    # Before, each query met its own cell: only those that came before enough copies do, and those at borders of keys.
    assert max(met) < 300
