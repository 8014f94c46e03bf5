"""Toxicity by weak supervision.

1. Terms (words, and beginnings of words) that mark labelled rows are found by
   a likelihood-ratio test. They make the lexicon.
   Terms that begin alike are one family.
2. Voters look at a text: one for each strong family, and patterns over the
   lexicon (hits, different hits, hits per word, few or none).
3. A generative label model estimates, from how voters agree, the share of
   toxic texts, each voter's accuracy and the voters' correlations. Votes that
   repeat each other count less. It gives a posterior per text.
4. A linear classifier is trained on the posteriors, and scores every text.

The fit uses at most about `fit_rows` labelled rows, drawn by hash; copies
count once. Scoring covers all rows and whole texts. Nothing but the text is
an input of a score.

Null text is empty. A row without doc_id is scored like any other and is not
in the held-out part; it never has a label. Of several labels of one doc_id
the highest counts. Labels other than 0 and 1 are ignored. Where labels lack
toxic rows, every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import forget, small_batches, stored, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class FitSize:
    """Bounds of the fit; none of them touches scoring."""

    fit_rows: int = 24_000
    terms: int = 400
    single_voters: int = 40
    least_ratio: float = 8.0
    least_g: float = 20.0


def terms_of(text: str) -> set[str]:
    """Words of a text, and with a trailing * the beginnings of its longer words."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def families(terms: list[str]) -> list[str]:
    """Terms, strongest first, without those that begin like an earlier one or that an earlier one begins like."""
    kept: list[str] = []
    for term in terms:
        stem = term.rstrip("*")
        if not any(stem.startswith(k.rstrip("*")) or k.rstrip("*").startswith(stem) for k in kept):
            kept.append(term)
    return kept


class Lexicon:
    """Which families the words of a text belong to: an exact word, or words of one beginning."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.starts = {t.rstrip("*")[:4] for t in terms}

    def hits(self, text: str) -> tuple[Counter, int]:
        """Words of each family, and words in all."""
        words = WORD.findall(text.lower())
        found: Counter = Counter()
        starts, place = self.starts, self.place
        for w in words:
            if w[:4] in starts:
                for term in (w, *(w[:n] + "*" for n in PREFIXES)):
                    if (at := place.get(term)) is not None:
                        found[at] += 1
                        break
        return found, len(words)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, size: FitSize) -> DataFrame:
    """(text, toxic) of a bounded draw of labelled rows outside the held-out part; copies once."""
    small_batches(docs)
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, size.fit_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(drawn, "doc_id").select("text", "toxic")
    return _one_of_each(rows, F.xxhash64("text"))


def _one_of_each(rows: DataFrame, key: Column) -> DataFrame:
    """One row for each key, the same in every run."""
    least = F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), -F.col("toxic")))
    return rows.groupBy(key.alias("key")).agg(least.alias("row")).select("row.*")


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: in how many texts of each class a term is."""
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            (toxic if label else clean).update(terms_of(text))
        names = list(toxic | clean)
        yield pd.DataFrame({"term": names, "toxic": [toxic[t] for t in names], "clean": [clean[t] for t in names]})


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with a key that near copies tend to share: their three smallest hashes of word pairs."""
    for batch in batches:
        keys = []
        for text in batch["text"]:
            words = WORD.findall(text.lower())
            pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)
            hashes = sorted(pd.util.hash_array(np.array(list(pairs), dtype=object), categorize=False))[:3] if pairs else []
            keys.append("-".join(map(str, hashes)))
        yield batch.assign(sketch=keys)


def find_terms(train: DataFrame, size: FitSize) -> list[str]:
    """The terms that mark toxic rows most strongly; at most `size.terms` of them reach the driver."""
    totals = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(totals["t"] or 0), int(totals["n"]) - int(totals["t"] or 0)
    if not toxic or not clean:
        return []
    counts = train.mapInPandas(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = toxic / (toxic + clean)
    both = F.col("a") + F.col("b")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(F.lit(0.0))
    ratio = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))
    strong = counts.filter(F.col("a") >= 2).select(
        "term", (2 * (part(F.col("a"), share) + part(F.col("b"), 1 - share))).alias("g"), ratio.alias("ratio"),
    ).filter((F.col("g") >= size.least_g) & (F.col("ratio") >= size.least_ratio))
    return families([r["term"] for r in strong.orderBy(F.desc(F.round("g", 6)), F.desc(F.length("term")), "term").limit(size.terms).collect()])


#: Shares of hits among the words that voters and classifier look at.
DENSITIES = (1 / 400, 1 / 200, 1 / 120, 1 / 80, 1 / 50, 1 / 25)


def votes(hits: np.ndarray, words: np.ndarray, singles: int) -> np.ndarray:
    """Votes of all voters on rows given by their hits per family; the last ones speak for clean."""
    words = np.maximum(words, 1)
    total, different = hits.sum(axis=1), (hits > 0).sum(axis=1)
    odd, even = hits[:, 1::2].sum(axis=1), hits[:, ::2].sum(axis=1)
    patterns = [total / words >= d for d in DENSITIES] + [total >= n for n in (1, 2, 3, 5)] + [different >= 2]
    clean = [total == 0, total <= 1, total / words < 1 / 120, (odd <= 1) & (odd < words / 200), (even <= 1) & (even < words / 200)]
    own = hits[:, :singles] >= np.maximum(1, words[:, None] / 300)
    return np.column_stack([own, *patterns, *clean]).astype(float)


def label_model(fired: np.ndarray, start: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the toxic class from votes alone, by expectation maximisation from a first guess.

    Each voter has a rate of firing on either class. The correlation of
    voters within a class shares the weight of a vote among those that
    repeat it.
    """
    p = start.astype(float)
    for _ in range(rounds):
        one, zero = (p * weight), ((1 - p) * weight)
        rate1 = (one @ fired + 0.5) / (one.sum() + 1)
        rate0 = (zero @ fired + 0.5) / (zero.sum() + 1)
        prior = (one.sum() + 0.5) / (weight.sum() + 1)
        rest = fired - (p[:, None] * rate1 + (1 - p)[:, None] * rate0)
        spread = np.sqrt((weight[:, None] * rest**2).sum(axis=0) / weight.sum()) + 1e-9
        alike = np.abs((rest * weight[:, None]).T @ rest / weight.sum() / np.outer(spread, spread))
        np.fill_diagonal(alike, 1.0)
        share = 1 / alike.sum(axis=0)
        gain = fired @ (share * np.log(rate1 / rate0)) + (1 - fired) @ (share * np.log((1 - rate1) / (1 - rate0)))
        p = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain, -30, 30)))
    return p


def features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: each family's share of the words in steps, that of all, and numbers of hits."""
    words = np.maximum(words, 1)
    total = hits.sum(axis=1)
    return np.column_stack([
        hits > 0, hits >= words[:, None] / 200, *[(total > 0) & (total / words >= d) for d in DENSITIES],
        total >= 1, total >= 2, total >= 3, np.log1p((hits > 0).sum(axis=1)), np.ones(len(hits)),
    ]).astype(float)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.2, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    terms: list[str]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, size: FitSize = FitSize()) -> Model | None:
    """Lexicon, label model and classifier from labelled rows; None where labels lack a class."""
    train = training_rows(docs, labels, size).mapInPandas(_sketch, "text string, toxic int, sketch string")
    train = stored(_one_of_each(train, F.col("sketch")), "toxicity-train")
    terms = find_terms(train, size)
    if not terms:
        return None

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for batch in batches:
            found = [lexicon.hits(t) for t in batch["text"]]
            yield pd.DataFrame({
                "places": [sorted(f) for f, _ in found], "times": [[f[i] for i in sorted(f)] for f, _ in found],
                # Only its ratio to hits matters, so texts without a hit make one group.
                "words": [n if f else 0 for f, n in found], "toxic": batch["toxic"].to_numpy()})

    seen = train.mapInPandas(patterns, "places array<int>, times array<int>, words long, toxic int")
    rows = seen.groupBy("places", "times", "words").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).toPandas()
    # In one order, whatever order the groups came in.
    shape = [(*p, -1, *t, -1, w) for p, t, w in zip(rows["places"], rows["times"], rows["words"], strict=True)]
    rows = rows.iloc[sorted(range(len(rows)), key=shape.__getitem__)].reset_index(drop=True)
    hits = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for i, (places, times) in enumerate(zip(rows["places"], rows["times"], strict=True)):
        hits[i, np.asarray(places, dtype=int)] = times
    words, weight = rows["words"].to_numpy(float), rows["n"].to_numpy(float)
    guess = (rows["t"].to_numpy(float) + 0.1) / (weight + 0.2)
    posterior = label_model(votes(hits, words, size.single_voters), guess, weight)
    return Model(terms, logistic(features(hits, words), posterior, weight))


def score_with(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, and `toxicity` in 0 to 1 from the text alone."""
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))
    terms, weights = list(model.terms), model.weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        lexicon = Lexicon(terms)
        for texts in batches:
            hits = np.zeros((len(texts), len(terms)), dtype=np.float32)
            words = np.zeros(len(texts))
            for i, text in enumerate(texts):
                found, words[i] = lexicon.hits(text)
                for at, n in found.items():
                    hits[i, at] = n
            yield pd.Series(1 / (1 + np.exp(-np.clip(features(hits, words) @ weights, -30, 30))))

    return docs.withColumn("toxicity", score(text_or_empty()))


def toxicity(docs: DataFrame, labels: DataFrame, size: FitSize = FitSize()) -> DataFrame:
    """All columns of docs, with `held_out` and `toxicity`."""
    model = fit(docs, labels, size)
    return score_with(docs.withColumn("held_out", is_held_out(F.col("doc_id"))), model)
