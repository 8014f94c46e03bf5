"""Archives written and read back, and the merge of their index."""

import gzip
import hashlib
import heapq
import io
import random

import pytest
from pyspark.sql import functions as F
from samples import SF

from riskweave.llm import queries, warc

PAGES = "page_id bigint, url string, html string"


def some_pages():
    rng = random.Random(9)
    html = ["<p>" + "word " * 40 + f"{n}</p>" for n in range(6)] + ["short", "", None, "ü" * 99, "ü" * 40, "x" * 99, "x" * 100, "🙂" * 300_000]
    urls = ["http://www.b.example/a?q=1", "https://a.b.example:8443/ä b%20%zz", "http://c.example", "no address", "http://[broken", "", None,
            "HTTP://C.example/\r\nWARC-Type: x", "http://c.example:99999/"]
    rows = [(n, rng.choice(urls), rng.choice(html)) for n in range(150)]
    return rows + rows[3:9] + [(None, urls[0], html[0]), (None, urls[1], "only without page " * 20), (2**62 + 1, None, html[1])]


def expected(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    least = {}
    for p, d in data:
        if len(d) >= 100 and p is not None:
            least[d] = min(p, least.get(d, p))
    out = []
    for p, d in data:
        refers = least.get(d) if least.get(d) != p else None
        out.append((p, len(d), hashlib.sha256(d).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    rows = some_pages()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(warc, "FILE_BYTES", 2000)
        pages = spark.createDataFrame(rows, PAGES).select("*", *[F.lit("own").alias(c) for c in ("digest", "least", "n", "payload", "run", "captured")])
        day = F.concat(F.lit("2024-05-0"), (F.coalesce("page_id", F.lit(0)) % 5 + 1).cast("string"), F.lit("T07:08:09Z"))
        warc.write_archives(pages.repartition(3), folder, day)
    return folder, rows


def test_round_trip(spark, archive):
    folder, rows = archive
    index = warc.capture_index(spark, folder, merge_entries=20, run_entries=7)
    found = warc.with_payload_facts(index).select(COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)
    assert sorted((r.url for r in index.collect())) == sorted(u or "" for _, u, _ in rows)
    listed = index.orderBy("range", "rank").collect()
    assert len({r.range for r in listed}) > 1
    keys = [(r.url_key, r.captured, -(2**63) - 1 if r.page_id is None else int(r.page_id)) for r in listed]
    assert keys == sorted(keys)
    ours = warc.history(index, "http://b.example/a?q=1").collect()
    assert {r.page_id for r in ours} == {None if p is None else str(p) for p, u, _ in rows if u == "http://www.b.example/a?q=1"}
    one = next(r for r in listed if r.record_type == "response" and r.payload_bytes > 1_000_000)
    assert warc.read_payload(folder, one.file, one.offset, one.length) == ("🙂" * 300_000).encode()


def test_files_are_plain_archives(spark, archive):
    """Read by nothing of ours: gzip members that begin with the version, records as long as they say."""
    folder, rows = archive
    files, path = warc.files_at(folder)
    listed = {r.file: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
    assert len(listed) > 3
    seen = 0
    for name, said in listed.items():
        with files.open_input_file(f"{path}/archives/{name}") as source:
            data = source.read()
        assert len(data) == said.bytes
        stream = io.BytesIO(gzip.decompress(data))
        while line := stream.readline():
            assert line == b"WARC/1.1\r\n"
            fields = {}
            while (line := stream.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[name] = value
            stream.read(int(fields["Content-Length"]))
            assert stream.read(4) == b"\r\n\r\n" and fields["WARC-Type"] in ("response", "revisit")
            seen += 1
    assert seen == len(rows)


def test_damage_is_noticed():
    data = warc.record("1", "http://a.example/", "2024-01-01T00:00:00Z", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None)
    assert warc.parsed(gzip.decompress(data))["payload"] == b"x" * 500
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(gzip.decompress(data).replace(b"xxx", b"xyx", 1))
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.members(io.BytesIO(data + data[:-9])))
    assert [(a, n) for a, n, _ in warc.members(io.BytesIO(data * 3))] == [(i * len(data), len(data)) for i in range(3)]


def test_files_of_lost_tasks_are_not_read(spark, archive):
    folder, rows = archive
    files, path = warc.files_at(folder)
    with files.open_output_stream(f"{path}/archives/part-00000-000-9999.warc.gz", compression=None) as out:
        out.write(b"half a record")
    assert warc.read_records(spark, folder).count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64])
def test_loser_tree(n):
    rng = random.Random(n)
    lists = [sorted(rng.choices(range(30), k=rng.randrange(12))) for _ in range(n)]
    found = [(lists[i][p], i) for i, p in warc.LoserTree(lists)]
    assert found == list(heapq.merge(*[[(x, i) for x in values] for i, values in enumerate(lists)]))


def test_url_keys():
    assert warc.url_key("https://www.A.Example.com:443/x/y?b=2#top") == "com,example,a)/x/y?b=2"
    assert warc.url_key("http://a.example:81") == "example,a:81)/" and warc.url_key("") == "" and warc.url_key("http://[x") == "http://[x"


def test_warc_query(spark, tmp_path):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op13_warc(spark, SF).select(COLUMNS).collect()), key=repr) == expected(pages)
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op13_warc(spark, str(tmp_path)).count() == 0
