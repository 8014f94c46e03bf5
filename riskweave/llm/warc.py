"""Web archives: written, read back, and indexed by an external merge.

Pages become WARC records, each a gzip member of its own, in files of bounded
size. Of equal payloads only the page with the smallest id is a response; the
others are revisits that refer to it and have no payload. A task's files carry
its attempt's number, and a manifest, written when the tasks have ended, lists
those that count: a task that is lost leaves files that nobody reads.

Reading goes file by file and member by member, and checks each payload
against its digest. What is read is sorted in runs of bounded size by URL key
and time of capture. Ranges of these keys are then merged, each from all runs
by a tree of losers; range after range the entries are in the order of the
histories of all URLs. A range has a bounded number of entries, also of a URL
with very many captures.

Null html is an empty payload, a null url an empty one, which has a key of its
own; no url is dropped or followed. A page without page_id is a response if all
equal payloads are without, else a revisit. Rows that repeat the smallest page
are responses too. Extra columns are left out; an empty table has no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import id_number, id_text, salted_join, skewed_join, small_batches, stored

#: Payloads of fewer bytes are not worth a revisit.
LEAST_BYTES = 100
FILE_BYTES, RUN_ENTRIES, MERGE_ENTRIES = 256 << 20, 50_000, 50_000
READ_BYTES, LEVEL = 1 << 20, 3

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, bytes bigint, records bigint"
RECORD = "page_id string, url string, captured string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"
ENTRY = f"{RECORD}, file string, offset bigint, length bigint, url_key string"
KEYS = ["url_key", "captured", "page"]


def files_at(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that a folder's address names, and the folder's path there."""
    if uri.startswith("file:/"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ---- records ----------------------------------------------------------------

def record(page_id: str | None, url: str, captured: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record as a gzip member; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{page_id or ''}>",
        f"WARC-Date: {captured}", f"WARC-Target-URI: {quote(url, safe=SAFE)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


#: Everything printable stays as it is in an address but for the sign that escapes others.
SAFE = "".join(map(chr, range(33, 127))).replace("%", "")


def members(source: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file."""
    start, data = 0, b""
    while True:
        data = data or source.read(READ_BYTES)
        if not data:
            return
        unpacker, content, read = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data and not (data := source.read(READ_BYTES)):
                raise ValueError(f"the record at {start} breaks off")
            content.append(unpacker.decompress(data))
            read, data = read + len(data) - len(unpacker.unused_data), unpacker.unused_data
        yield start, read, b"".join(content)
        start += read


def parsed(content: bytes) -> dict:
    """Fields and payload of a record; ValueError if the payload of a response has not its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = lambda name: fields.get(name, "")[len("<urn:page:"):-1] or None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
    return {"page_id": page("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]), "captured": fields["WARC-Date"], "record_type": kind,
            "refers_to": page("WARC-Refers-To"), "payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def url_key(url: str) -> str:
    """An address with the parts of its host in reverse, so that a domain's pages are together."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.removeprefix('www.').split('.')))}{port}){parts.path or '/'}{query}"


# ---- archives ---------------------------------------------------------------

def with_record_types(pages: DataFrame, captured: Column) -> DataFrame:
    """page_id, url, captured, payload, digest, and refers_to: the page a revisit refers to, null for responses."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        captured.alias("captured"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    least = rows.filter(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    several = least.filter("n > 1 and least is not null").select("digest", "least")
    found = salted_join(rows, several, "digest", "left")
    return found.withColumn("refers_to", F.when(~F.col("least").eqNullSafe(F.col("page_id")), F.col("least"))).drop("least")


def write_archives(pages: DataFrame, folder: str, captured: Column | str = "2024-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) rows as WARC files and a manifest below a folder. `captured` is the time, in text."""
    captured = F.lit(captured) if isinstance(captured, str) else captured
    to, path = files_at(folder)
    to.create_dir(f"{path}/archives")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = files_at(folder)
        task, number, out = TaskContext.get(), 0, None
        name, size, records = "", 0, 0
        done: list[tuple] = []

        def close() -> None:
            out.close()
            done.append((name, size, records))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name, size, records = f"part-{task.partitionId():05d}-{number:03d}-{task.taskAttemptId()}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/archives/{name}", compression=None)
                data = record(row.page_id, row.url, row.captured, row.payload, row.digest, row.refers_to)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    close()
                    number, out = number + 1, None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "bytes", "records"])

    rows = with_record_types(small_batches(pages), captured)
    rows = rows.select(id_text("page_id"), "url", "captured", "payload", "digest", id_text("refers_to"))
    rows.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives that the manifest lists, without payloads, each with its place and URL key."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = files_at(folder)
        for batch in batches:
            for name in batch["file"]:
                rows: list[dict] = []
                with store.open_input_stream(f"{base}/archives/{name}", compression=None) as source:
                    for offset, length, content in members(source):
                        found = parsed(content)
                        del found["payload"]
                        rows.append(found | {"file": name, "offset": offset, "length": length, "url_key": url_key(found["url"])})
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.select("file").repartition(max(1, files.count()), "file").mapInPandas(read, ENTRY)


def read_payload(folder: str, file: str, offset: int, length: int) -> bytes:
    """The payload of one record of an archive."""
    store, base = files_at(folder)
    with store.open_input_file(f"{base}/archives/{file}") as source:
        source.seek(offset)
        return parsed(zlib.decompress(source.read(length), 31))["payload"]


# ---- index ------------------------------------------------------------------

class LoserTree:
    """Merges sorted lists: each inner node holds the loser of its match, the top the winner of all."""

    def __init__(self, lists: list[list]):
        self.lists, self.at = lists, [0] * len(lists)
        self.tree = [-1] * max(1, len(lists))
        for i in reversed(range(len(lists))):
            self.play(i)

    def beats(self, a: int, b: int) -> bool:
        """Whether list a's next is before list b's; -1, not yet placed, is before all, an empty list behind."""
        if a < 0 or b < 0:
            return a < 0
        if self.at[a] == len(self.lists[a]) or self.at[b] == len(self.lists[b]):
            return self.at[a] < len(self.lists[a])
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or x == y and a < b

    def play(self, i: int) -> None:
        node = (i + len(self.lists)) // 2
        while node:
            if self.beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place in it) of all entries in order."""
        for _ in range(sum(map(len, self.lists))):
            i = self.tree[0]
            yield i, self.at[i]
            self.at[i] += 1
            self.play(i)


def sort_keys(frame: pd.DataFrame) -> list[tuple]:
    """What entries are ordered by; those without page come first."""
    pages = [-(2**63) - 1 if p is None or p != p else int(p) for p in frame["page_id"]]
    return list(zip(frame["url_key"], frame["captured"], pages, frame["file"], frame["offset"].tolist(), strict=True))


def sorted_runs(entries: DataFrame, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """Entries in sorted runs: with `run` and `place`, the place in it."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def run() -> pd.DataFrame:
            frame = pd.concat(held)
            keys = sort_keys(frame)
            frame = frame.iloc[sorted(range(len(keys)), key=keys.__getitem__)]
            return frame.assign(run=f"{task}-{number}", place=range(len(frame)))

        for batch in batches:
            while len(batch):
                room = run_entries - sum(map(len, held))
                held.append(batch[:room])
                batch = batch[room:]
                if sum(map(len, held)) == run_entries:
                    yield run()
                    held, number = [], number + 1
        if held:
            yield run()

    return entries.mapInPandas(sort, f"{ENTRY}, run string, place bigint")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(batches)
    if not sum(map(len, frames)):
        return
    frame = pd.concat(frames, ignore_index=True)
    keys = sort_keys(frame)
    starts = (frame["run"] != frame["run"].shift()).to_numpy().nonzero()[0].tolist()
    lists = [keys[a:z] for a, z in zip(starts, [*starts[1:], len(keys)], strict=True)]
    order = [starts[i] + place for i, place in LoserTree(lists)]
    merged = frame.drop(columns=["run", "place", "page"]).iloc[order].assign(rank=range(len(order)))
    for start in range(0, len(merged), 10_000):
        yield merged.iloc[start:start + 10_000]


def capture_index(spark: SparkSession, folder: str, merge_entries: int = MERGE_ENTRIES, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """All captures in the order of URL key, time and page: by `range`, then by `rank` in it.

    Columns of records, file, offset, length, url_key. Written below the folder.
    """
    runs = stored(sorted_runs(read_records(spark, folder), run_entries), "runs")
    ranges = max(1, -(-runs.count() // merge_entries))
    slices = runs.withColumn("page", F.col("page_id").cast("bigint")).repartitionByRange(ranges, *KEYS, "file", "offset")
    merged = slices.sortWithinPartitions("run", "place").mapInPandas(_merge, f"{ENTRY}, rank bigint")
    merged = merged.withColumn("range", F.spark_partition_id())
    merged.write.parquet(f"{folder}/index")
    return spark.read.schema(merged.schema).parquet(f"{folder}/index")


def history(index: DataFrame, url: str) -> DataFrame:
    """The captures of one URL in order of time."""
    return index.filter(F.col("url_key") == url_key(url)).orderBy("range", "rank")


def with_payload_facts(index: DataFrame) -> DataFrame:
    """The index with payload_bytes and payload_digest of revisits taken from the responses that they refer to."""
    rows = id_number(id_number(index, "page_id"), "refers_to")
    revisits = rows.filter("refers_to is not null").drop("payload_bytes", "payload_digest")
    wanted = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    responses = rows.filter("refers_to is null").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    found = wanted.join(responses, "refers_to").groupBy("refers_to", "n").agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    resolved = skewed_join(revisits, found, "refers_to", "n").drop("n")
    return rows.filter("refers_to is null").unionByName(resolved.select(rows.columns))
