"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

Each paragraph (text between line feeds) is hashed to a wide vector. A
document's vector is the sum of its paragraphs' vectors, part by part, modulo
a power of two. So the order of paragraphs plays no part, a paragraph is
inserted by adding its vector and deleted by subtracting it, and documents
with equal paragraphs have equal vectors.

The vector has two halves. `exact` are sums of hashes of whole paragraphs
modulo 2**40: they tell paragraphs apart. `sketch` are counts modulo 2**16:
each run of up to `PIECE_WORDS` words of a paragraph adds 1 or -1 to one of
`LANES` lanes. Read as signed numbers, the lanes' inner product estimates how
many runs two documents share: 2 u.v / (u.u + v.v), held to 0..1, is their
likeness; about 1/sqrt(LANES) is chance.

Only column expressions are used. Null text is empty. Rows come back as often
as they came; rows without doc_id come before all others, and rows of one
doc_id are ordered by a hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import bucket_bounds, bucket_of, text_or_empty

WIDE, WIDE_BITS = 8, 40
LANES, LANE_BITS = 64, 16
PIECE_WORDS = 6
GROUPS = 8

#: Up to PIECE_WORDS words of one paragraph with the blanks after them.
PIECES = r"(?:\S++[ \t]*+){1,%d}" % PIECE_WORDS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value inside lambdas without computing it there anew."""
    return F.transform(F.array(value), use)[0]


def exact_part(text: Column) -> Column:
    """Sums of the hashes of whole paragraphs."""
    cut = F.lit((1 << WIDE_BITS) - 1)

    def total(paragraphs: Column, seed: int) -> Column:
        return F.aggregate(paragraphs, F.lit(0).cast("bigint"), lambda so_far, paragraph: (
            so_far + F.xxhash64(paragraph, F.lit(seed)).bitwiseAND(cut)).bitwiseAND(cut))

    return let(F.split(text, "\n", -1), lambda paragraphs: F.array(*[total(paragraphs, seed) for seed in range(WIDE)]))


def sketch_part(text: Column) -> Column:
    """Signed counts of the lanes, modulo 2**LANE_BITS."""
    # Twice the lane, and one more for the sign.
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    marks = F.transform(pieces, lambda piece: F.xxhash64(piece).bitwiseAND(F.lit(2 * LANES - 1)).cast("int"))

    def count(marks: Column, lane: Column) -> Column:
        n = F.aggregate(marks, F.lit(0), lambda n, m: n + (m == lane).cast("int") - (m == lane + 1).cast("int"))
        return F.pmod(n, F.lit(1 << LANE_BITS))

    # Lanes are counted in groups, so that a lane looks only at its group's marks.
    span = 2 * LANES // GROUPS

    def group(marks: Column, start: Column) -> Column:
        own = F.filter(marks, lambda m: (m >= start) & (m < start + span))
        lanes = F.sequence(start, start + span - 2, F.lit(2))
        return let(own, lambda own: F.transform(lanes, lambda lane: count(own, lane)))

    starts = F.sequence(F.lit(0), F.lit(2 * LANES - span), F.lit(span))
    return F.flatten(let(marks, lambda marks: F.transform(starts, lambda start: group(marks, start))))


def vector(text: Column) -> Column:
    return F.struct(exact_part(text).alias("exact"), sketch_part(text).alias("sketch"))


def add(one: Column, other: Column, times: int = 1) -> Column:
    """Vector of the paragraphs of both; times=-1 takes the other's paragraphs out."""
    def total(part: str, bits: int) -> Column:
        return F.zip_with(one[part], other[part], lambda a, b: F.pmod(a + b * times, F.lit(1 << bits)))

    return F.struct(total("exact", WIDE_BITS).alias("exact"), total("sketch", LANE_BITS).alias("sketch"))


def fingerprint(v: Column) -> Column:
    """A vector in hexadecimal digits."""
    wide = F.transform(v["exact"], lambda x: F.lpad(F.hex(x), WIDE_BITS // 4, "0"))
    lanes = F.transform(v["sketch"], lambda x: F.lpad(F.hex(x.cast("bigint")), LANE_BITS // 4, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(lanes, "")))


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of common word runs, from 0 to 1; equal vectors have 1."""
    half = 1 << (LANE_BITS - 1)
    signed = lambda x: (x + F.when(x >= half, -2 * half).otherwise(0)).cast("double")
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: signed(x) * signed(y)), F.lit(0.0), lambda total, x: total + x)
    u, v = one["sketch"], other["sketch"]
    size = dot(u, u) + dot(v, v)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot(u, v) / size))
    return F.when(one == other, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(near)


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = 2000) -> DataFrame:
    """Rows of (doc_id, text, ...) with each column's value in the next row by doc_id; after the last comes the first.

    Rows are dealt into ranges of doc_id. The first row of a range is also
    put behind the range before, so that each range answers for itself.
    """
    bounds = bucket_bounds(docs, "doc_id", rows_per_bucket, most=2000)
    first = docs.agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bucket = bucket_of(F.col("doc_id"), bounds)
    begins = F.col("doc_id").isNull() if first["nulls"] else F.col("doc_id") == F.lit(first["least"])
    before = F.when(begins, F.lit(len(bounds))).when(
        F.col("doc_id").isin(bounds) if bounds else F.lit(False), bucket - 1)
    homes = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("ghost")),
                                    F.when(before.isNotNull(), F.struct(before.alias("bucket"), F.lit(1).alias("ghost")))))
    rows = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_home", F.explode(homes))
    order = Window.partitionBy("_home.bucket").orderBy("_home.ghost", F.asc_nulls_first("doc_id"), "_tie")
    found = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return found.filter(F.col("_home.ghost") == 0).drop("_home", "_tie")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    own = rows.withColumn("vector", vector(F.col("text")))
    pairs = with_next(own, ["text", "vector"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    told = pairs.select(
        "doc_id", n.cast("bigint").alias("n_chars"), "vector", "next_vector", edited.alias("edited")
    ).withColumn("edited_vector", vector(F.col("edited")))
    return told.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("vector")).alias("fingerprint"), fingerprint(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
