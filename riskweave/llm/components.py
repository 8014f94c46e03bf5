"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import salted_join, stored


#: Edges a task takes; a small graph then needs few tasks, however many partitions a shuffle has.
EDGES_PER_TASK = 50_000


def _star(arcs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Arcs (u, v) with the smallest neighbour m of u, itself among them; and (u, m) alone.

    A hub's arcs are combined before the first shuffle and salted in the second.
    """
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
    return salted_join(arcs, least, "u").coalesce(parts), least


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest."""
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = edges.select(F.explode(both).alias("e")).select("e.*")
    found, _ = _star(arcs, parts)
    return found.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Hang the smaller neighbours of each node, and itself, on its smallest."""
    arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found, least = _star(arcs, parts)
    hung = found.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct().coalesce(parts)


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
    told = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return told.filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): the smallest node reachable.

    Stars grow alternately over larger and smaller neighbours until every
    node hangs on its root; each round is written to the shared folder.
    """
    edges = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    parts = max(1, -(-edges.count() // EDGES_PER_TASK))
    for _ in range(most_rounds):
        edges = stored(_small_star(_large_star(edges, parts), parts), "edges")
        if _is_settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
