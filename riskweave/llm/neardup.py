"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles, the set's minima under many
   hash functions, keys of bands of minima, and a signature that keeps only
   the low bits of each minimum. Equal sets become one representative.
2. Representatives that share a band key are candidates. Inside a bucket,
   packed signatures are compared by bit counts; the share of equal low bits,
   corrected for chance collisions, estimates the similarity. Pairs well below
   the threshold go. What stays joins representatives into clusters. A bucket
   of more than `bucket_rows` representatives becomes a cluster as a whole:
   that may only make clusters larger.
3. Inside a cluster links are confirmed on full sets, in blocks of bounded
   size. Large clusters are compared block by block and with some centres all
   over; what is then not in the cluster's largest class is compared with all
   of it. So no link between different classes is missed, and no task or row
   grows with a cluster.
4. Connected links are classes.

A task emits a spanning forest of the links it finds, not the pairs.

Null text is empty; a text without words has an empty set and is linked with
nothing. Rows without doc_id take no part: they have no class and are kept.
Every row stands for its own text, also where a doc_id is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import forget, id_number, id_text, salted_join, small_batches, stored, text_or_empty
from riskweave.llm.components import components
from riskweave.llm.shingles import Shingler, mix

MINIMA, LOW_BITS = 128, 4
PER_LONG = 64 // LOW_BITS


@dataclass(frozen=True)
class NearDup:
    """Five words and a similarity of 0.8 unless a caller says otherwise."""

    words: int = 5
    percent: int = 80
    bands: int = 28
    band_rows: int = 4
    # Estimates err by about 0.037; this is 4.5 times that.
    slack: float = 0.165
    bucket_rows: int = 512
    block_rows: int = 256
    centres: int = 16
    rest_rows: int = 128


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(7, 7 + 2 * MINIMA, dtype=np.uint64))
    return (seeds[:MINIMA] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[MINIMA:] >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest hash of a set under each function."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 4096):
        part = low[None, start:start + 4096] * a[:, None] + b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed."""
    low = (least & np.uint32((1 << LOW_BITS) - 1)).astype(np.uint64).reshape(-1, PER_LONG)
    return (low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS))).sum(axis=1, dtype=np.uint64)


def estimate(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for low bits that agree by chance."""
    differ = one ^ other
    shift = 1
    while shift < LOW_BITS:
        differ = differ | (differ >> np.uint64(shift))
        shift *= 2
    lowest = np.uint64(sum(1 << (i * LOW_BITS) for i in range(PER_LONG)))
    unequal = np.bitwise_count(differ & lowest).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-LOW_BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect what was not connected before."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches; a run may go over the end of a batch."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        values = frame[keys].to_numpy()
        edges = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            yield frame.iloc[start:end]
        rest = frame.iloc[edges[-1]:]
    if rest is not None:
        yield rest


def sketch(docs: DataFrame, how: NearDup) -> DataFrame:
    """doc_id, n_shingles, two numbers that tell sets apart, band keys, signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingler = Shingler(how.words)
        a, b = multipliers()
        weights = mix(np.arange(1, 1 + how.band_rows, dtype=np.uint64)) | np.uint64(1)
        seeds = mix(np.arange(10_000, 10_000 + how.bands, dtype=np.uint64))
        for batch in batches:
            n, one, two, keys, signs = [], [], [], [], []
            for found in shingler.sets(list(batch["text"])):
                n.append(len(found))
                one.append(mix(found).sum(dtype=np.uint64))
                two.append(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if len(found):
                    least = minima(found, a, b)
                    rows = least[: how.bands * how.band_rows].astype(np.uint64).reshape(how.bands, how.band_rows)
                    keys.append(mix((rows * weights).sum(axis=1, dtype=np.uint64) ^ seeds).view(np.int64))
                    signs.append(signature(least).view(np.int64))
                else:
                    keys.append([])
                    signs.append([])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": n, "set_one": np.array(one, dtype=np.uint64).view(np.int64),
                "set_two": np.array(two, dtype=np.uint64).view(np.int64), "bands": keys, "signature": signs})

    text = text_or_empty()
    rows = small_batches(docs).select(id_text(), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return id_number(rows.mapInPandas(run, "doc_id string, text_hash bigint, n_shingles bigint, set_one bigint, "
                                           "set_two bigint, bands array<bigint>, signature array<bigint>"))


def likely_edges(reps: DataFrame, how: NearDup) -> DataFrame:
    """Edges (a, b) that connect representatives whose estimated similarity is near the threshold or above."""
    rows = reps.select("rep", F.explode("bands").alias("key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).filter(F.col("n") > 1)
    shared = stored(rows.join(keys, "key"), "buckets")
    large = shared.filter((F.col("n") > how.bucket_rows) & (F.col("rep") != F.col("first"))).select(
        F.col("rep").alias("a"), F.col("first").alias("b"))
    least = how.percent / 100 - how.slack

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for bucket in groups(batches, ["key"]):
            if len(bucket) < 2:
                continue
            reps = bucket["rep"].to_numpy()
            size = bucket["n_shingles"].to_numpy()
            signs = np.stack(bucket["signature"].to_numpy()).view(np.uint64)
            i, j = np.triu_indices(len(reps), 1) if len(reps) > 2 else (np.array([0]), np.array([1]))
            near = estimate(signs[i], signs[j]) >= least
            near &= 100 * np.minimum(size[i], size[j]) >= how.percent * np.maximum(size[i], size[j])
            pairs = forest(len(reps), zip(i[near].tolist(), j[near].tolist(), strict=True))
            found += [(int(reps[x]), int(reps[y])) for x, y in pairs]
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    small = shared.filter(F.col("n") <= how.bucket_rows).select("key", "rep").join(
        reps.select("rep", "n_shingles", "signature"), "rep")
    dealt = small.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "a bigint, b bigint").unionByName(large)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a left and a right set whose similarity reaches the threshold, on full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.r_[True, every[1:] != every[:-1]]
    group = np.cumsum(first) - 1
    counts = np.bincount(group)
    useful = counts[group] > 1
    owner, group = owner[useful], group[useful]
    _, column = np.unique(group, return_inverse=True)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    if len(column):
        width = 16_384
        place_left, place_right = np.full(n, -1), np.full(n, -1)
        place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
        for start in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [start, start + width])
            who, at = owner[a:b], column[a:b] - start
            m = [np.zeros((len(side), width), dtype=np.float32) for side in (left, right)]
            for matrix, place in zip(m, (place_left, place_right), strict=True):
                here = place[who] >= 0
                matrix[place[who][here], at[here]] = 1
            common += m[0] @ m[1].T
    common = np.rint(common).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    i, j = np.nonzero((100 * common >= percent * union) & (left[:, None] != right[None, :]))
    return zip(left[i].tolist(), right[j].tolist(), strict=True)


def links(members: DataFrame, how: NearDup, keys: list[str], left_only: bool) -> DataFrame:
    """Edges of a spanning forest of the links in each group of (keys, rep, set_one, set_two, text, left)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(how.words)
        found: list[tuple[int, int]] = []
        for block in groups(batches, keys):
            sets = shingler.sets(list(block["text"]))
            # A repeated doc_id may bring another text along; a row may come twice.
            mine = [i for i, s in enumerate(sets) if mix(s).sum(dtype=np.uint64).view(np.int64) == block["set_one"].iloc[i]]
            block, sets = block.iloc[mine], [sets[i] for i in mine]
            reps = block["rep"].to_numpy()
            if len(reps) < 2:
                continue
            every = np.arange(len(reps))
            left = np.flatnonzero(block["left"].to_numpy()) if left_only else every
            pairs = linked(sets, left, every, how.percent) if len(left) else iter(())
            found += [(int(reps[i]), int(reps[j])) for i, j in forest(len(reps), pairs)]
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a bigint, b bigint").filter(F.col("a") != F.col("b"))


def confirmed_edges(docs: DataFrame, reps: DataFrame, clusters: DataFrame, how: NearDup) -> DataFrame:
    """Edges that connect exactly the representatives that links on full sets connect, inside each cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    sized = salted_join(clusters, sizes, "cluster").join(reps.select("rep", "set_one", "set_two"), "rep")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), text_or_empty().alias("text"))
    members = stored(texts.join(sized, "rep"), "cluster-members").withColumn(
        "blocks", F.ceil(F.col("size") / how.block_rows).cast("int"))
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    own = F.pmod(spread, F.col("blocks")).cast("int")
    centre = (F.col("blocks") > 1) & (spread * F.col("size") < float(how.centres) * (1 << 30))
    blocked = members.withColumn("block", F.explode(
        F.when(centre, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))).withColumn("left", F.lit(True))
    first = stored(links(blocked, how, ["cluster", "block"], left_only=False), "links")
    large = members.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return first
    # What is not in the largest class of a large cluster meets all of the cluster.
    roots = components(first)
    classed = large.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "root", F.coalesce("root", "rep"))
    counts = classed.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    told = salted_join(classed, main.filter(F.col("others") > 0), "cluster").withColumn(
        "left", F.col("root") != F.col("main")).withColumn(
        "rests", F.ceil(F.col("others") / how.rest_rows).cast("int"))
    columns = ("cluster", "rep", "set_one", "set_two", "text", "left", "rest", "block")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rests")).cast("int")
    asking = told.filter("left").withColumn("rest", rest).withColumn("block", upto("blocks")).select(*columns)
    asked = told.withColumn("left", F.lit(False)).withColumn("block", own).withColumn("rest", upto("rests")).select(*columns)
    second = links(asking.unionByName(asked), how, ["cluster", "rest", "block"], left_only=True)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and a hash of the text, of every row of (doc_id, text)."""
    rows = stored(sketch(docs, how), "sketches")
    whole = ["n_shingles", "set_one", "set_two"]
    full = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = stored(full.groupBy(*whole).agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "sets")
    clusters = stored(components(likely_edges(reps, how)).select(
        F.col("node").alias("rep"), F.col("root").alias("cluster")), "clusters")
    roots = components(confirmed_edges(docs, reps, clusters, how))
    classes = reps.select(*whole, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        *whole, F.coalesce("root", "rep").alias("component_id"))
    keyed = classes.withColumn("set", F.struct(*whole)).select("set", "component_id")
    out = salted_join(rows.select("doc_id", "text_hash", "n_shingles", F.struct(*whole).alias("set")), keyed, "set", "left", salts=16)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")
