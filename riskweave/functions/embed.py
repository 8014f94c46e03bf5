"""The built-in text embedding: word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.schemas import SPARSE


def word_buckets(text: Column, dimensions: int = V.EMBEDDING_DIMENSIONS) -> Column:
    """Lower-cased words as bucket numbers."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    return F.transform(
        words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")
    )


#: Rows laid out at once: a batch in double precision is many times as large as its words.
_ROWS_AT_ONCE = 512


def dense_units(buckets: pa.Array, dimensions: int) -> pa.Array:
    """Word counts per bucket, scaled to length one, a few rows at a time."""
    n, flat = len(buckets), buckets.flatten().to_numpy()
    offsets = buckets.offsets.to_numpy()
    ends = offsets - offsets[0]
    out = np.empty((n, dimensions), dtype=np.float32)
    for start in range(0, n, _ROWS_AT_ONCE):
        end = min(n, start + _ROWS_AT_ONCE)
        rows = np.repeat(np.arange(end - start), np.diff(ends[start:end + 1]))
        counts = np.bincount(rows * dimensions + flat[ends[start]:ends[end]], minlength=(end - start) * dimensions)
        counts = counts.reshape(end - start, dimensions).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        out[start:end] = np.divide(counts, norms, out=counts, where=norms > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimensions, pa.int32()), pa.array(out.ravel()))


def _densify(dimensions: int):
    @F.arrow_udf("array<float>")
    def densify(buckets: pa.Array) -> pa.Array:
        return dense_units(buckets, dimensions)

    return densify


def hash_embedding(text: Column, dimensions: int = V.EMBEDDING_DIMENSIONS) -> Column:
    """Word counts per bucket, scaled to length one.

    Words are hashed inside the JVM; a whole Arrow batch is laid out at once.
    """
    return _densify(dimensions)(word_buckets(F.coalesce(text, F.lit("")), dimensions))


def _count(dimensions: int):
    @F.arrow_udf(SPARSE)
    def count(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        rows = np.repeat(np.arange(n), np.diff(buckets.offsets.to_numpy()))
        keys, counts = np.unique(rows * dimensions + buckets.flatten().to_numpy(), return_counts=True)
        row, counts = keys // dimensions, counts.astype(np.float64)
        norms = np.sqrt(np.bincount(row, counts * counts, n))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
        lists = (pa.array((keys % dimensions).astype(np.int32)), pa.array((counts / norms[row]).astype(np.float32)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, x) for x in lists], names=SPARSE.names)

    return count


def sparse_hash_embedding(text: Column, dimensions: int = V.EMBEDDING_DIMENSIONS) -> Column:
    """The same numbers as places and weights of what is not zero."""
    return _count(dimensions)(word_buckets(F.coalesce(text, F.lit("")), dimensions))


#: Embedders whose vectors have few places other than zero name the form that says which.
hash_embedding.sparse = sparse_hash_embedding
