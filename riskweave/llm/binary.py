"""Token ids in files of bytes: common ids short, lengths apart from values.

Ids are replaced by their rank in the collection's frequencies, so that common
ones are small. A rank takes one to four bytes. Its length is two bits in a
control byte that serves four ranks; control bytes and value bytes lie apart.
Decoding looks control bytes up in a table of lengths and gathers values with
numpy.

A file holds whole documents, in ascending doc_id, from one range of doc_ids:

    magic 'RWT1' | documents u32 | ids u64 | doc_ids i64... | ids of each u32...
    | control bytes | value bytes

Files are rows of a Spark table (part, file, bytes), so that the write commits
as a whole on any store, and survives executors; `part` and `file` ascend with
doc_id. The rank table is in the same folder.

Null text is empty and has only the end id. Rows without doc_id come first.
Rows of one doc_id stay together, those with equal texts in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import id_number, id_text, small_batches, stored, tasks, text_or_empty
from riskweave.llm.tokens import encoder
from riskweave.session import scratch_dir

MAGIC = b"RWT1"
HEAD = "<4sIQ"
NO_ID = -(2**63)
FILE = "part int, file int, ids bigint, bytes binary"

#: Lengths of the four values of each control byte.
LENGTHS = np.array([[((c >> (2 * i)) & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = size - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    octets = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, octets: bytes, n: int) -> np.ndarray:
    """The n values of control bytes and value bytes."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(octets + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    out = data[start]
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        if not len(more):
            break
        out[more] |= data[start[more] + i] << np.uint32(8 * i)
    return out


def file_bytes(doc_ids: list[int], ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    counts = [len(x) for x in ids]
    control, octets = pack(rank_of[np.concatenate(ids)])
    return b"".join((
        struct.pack(HEAD, MAGIC, len(ids), sum(counts)), np.array(doc_ids, dtype="<i8").tobytes(),
        np.array(counts, dtype="<u4").tobytes(), control, octets))


def read_file(data: bytes, id_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and ids of each document of a file."""
    magic, docs, n = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at + 8 * docs).astype(np.int64)
    at += 12 * docs
    values = at + (n + 3) // 4
    ids = id_of[unpack(data[at:values], data[values:], n)]
    ends = np.cumsum(counts)
    for doc_id, start, end in zip(doc_ids.tolist(), ends - counts, ends, strict=True):
        yield doc_id, ids[start:end]


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) with the end id appended; ids as bytes, all low halves before all high halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = [words.encode(t) + end for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [halves(x) for x in ids]})

    rows = small_batches(docs).select(id_text(), text_or_empty().alias("text"))
    return id_number(rows.mapInPandas(run, "doc_id string, ids binary"))


def halves(ids: bytes) -> bytes:
    """Bytes of 32-bit ids by place; places that are all zero at the end are left out. These compress well."""
    octets = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    used = 4
    while used > 1 and not octets[:, used - 1].any():
        used -= 1
    return bytes([used]) + octets[:, :used].T.tobytes()


def whole(data: bytes) -> np.ndarray:
    used = data[0]
    octets = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(used, -1)
    out = np.zeros(octets.shape[1], dtype=np.int64)
    for i in range(used):
        out |= octets[i].astype(np.int64) << (8 * i)
    return out


def ranks(tokens: DataFrame) -> list[int]:
    """Ids from the most to the least frequent, over all rows. As many as the vocabulary has at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for data in batch["ids"]:
                found = np.bincount(whole(data))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    counted = tokens.select("ids").mapInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in counted.orderBy(F.desc("n"), "id").collect()]


def write_files(docs: DataFrame, folder: str, path: str, end_id: int, file_ids: int = 1 << 20) -> None:
    """Encode (doc_id, text) rows into files of about `file_ids` ids below a folder."""
    spark = docs.sparkSession
    tokens = stored(token_rows(docs, path, end_id), "token-ids")
    by_rank = np.array(ranks(tokens), dtype=np.int64)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        size = 0

        def made() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "file": [number], "ids": [size], "bytes": [file_bytes(doc_ids, ids, rank_of)]})

        for batch in batches:
            for doc_id, data in zip(batch["doc_id"], batch["ids"], strict=True):
                doc_ids.append(doc_id)
                ids.append(whole(data))
                size += len(ids[-1])
                if size >= file_ids:
                    yield made()
                    number, size = number + 1, 0
                    doc_ids.clear()
                    ids.clear()
        if ids:
            yield made()

    keyed = tokens.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    ordered = keyed.repartitionByRange(tasks(spark), "doc_id").sortWithinPartitions("doc_id")
    # The bytes are as dense as they get.
    ordered.mapInPandas(write, FILE).write.option("compression", "uncompressed").parquet(f"{folder}/files")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of all documents, ids as unsigned 32-bit little-endian bytes."""
    return _read(spark, folder, "ids binary", lambda ids: ids.astype("<u4").tobytes())


def _read(spark: SparkSession, folder: str, kind: str, make) -> DataFrame:
    """doc_id, start, n_tokens and what `make` makes of the ids."""
    id_of = np.frombuffer(spark.read.schema("ids binary").parquet(f"{folder}/ranks").first()["ids"], dtype="<u4")
    name = kind.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, number, data in zip(batch["part"], batch["file"], batch["bytes"], strict=True):
                rows, at = [], 0
                for doc_id, ids in read_file(data, id_of):
                    rows.append((part, number, None if doc_id == NO_ID else doc_id, at, len(ids), make(ids)))
                    at += len(ids)
                frame = pd.DataFrame(rows, columns=["part", "file", "doc_id", "at", "n_tokens", name])
                yield frame.astype({"doc_id": "Int64"})

    files = spark.read.schema(FILE).parquet(f"{folder}/files")
    sizes = files.select("part", "file", "ids")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    # One row for each part, of which there are as many as the writer had tasks.
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("file")
    starts = sizes.select("part", "file", (F.sum("ids").over(inside) - F.col("ids")).alias("first")).join(
        earlier, "part").select("part", "file", (F.col("first") + F.col("base")).alias("first"))
    docs = files.select("part", "file", "bytes").mapInPandas(
        run, f"part int, file int, doc_id bigint, at bigint, n_tokens bigint, {kind}")
    return docs.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", name)


def round_trip(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "token-files")
    write_files(docs, folder, path, end_id)
    return _read(spark, folder, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
