"""Page text on written pages, toxicity by held-out accuracy, and the pipeline stage by stage."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import SF, clashing, documents, odd_texts, prose, varied  # noqa: F401
from test_passages import plain_dedup
from test_search_and_secrets import plain_spans
from test_tokens import check_packing

from riskweave.llm import pages, toxicity
from riskweave.llm.queries import queries

WHOLE = """<!DOCTYPE html><html><head><title>Title</title><style>p{margin:0}</style></head><body class="content">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- a > comment -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><header><h1>A &amp; B</h1></header><p>First&nbsp;block
 goes   on.<br>More <b>bold</b> and <i>slanted</i>text</p><p>Unclosed <b>bold<p>Next &lt;b&gt; &eacute;
<aside>Side</aside><div class="advert">Buy</div><form><p>Name</p><input name="x"></form>
<script>var t = "</p>";</script><ul><li>One</li><li>Two</li></ul><section class="comments"><article><p>Reader</p></article></section>
<footer>Written by</footer></article><aside><p>Side</p></aside><footer>&copy; Site</footer></body></html>"""


def text_of(page):
    return pages.decided(pages.blocks_of(page))


def test_the_article_and_nothing_else():
    assert text_of(WHOLE) == "A & B\nFirst block goes on. More bold and slantedtext\nUnclosed bold\nNext <b> é\nOne\nTwo"


@pytest.mark.parametrize("page, expected", [
    ("", ""), ("<p>", ""), ("<html><body><main><p>Text</p></main><p>Else</p></body></html>", "Text"),
    ("<div id='content'><h2>Head</h2>Text</div><div>Else</div>", "Head\nText"),
    ("<article>One</article><p>Else</p><article>Two</article>", "One\nTwo"),
    ("<article><p title='a > b'>Quoted > sign</p></article>", "Quoted > sign"),
    ("<ARTICLE><P>Upper</P></ARTICLE><NAV>Menu</NAV>", "Upper"),
    ("<nav>Menu</nav><article><div class='sidebar'>Side</div>Body</article>", "Body"),
    ("<article>a &#8364; &amp;amp; &bogus; b</article>", "a € &amp; &bogus; b"),
    ("<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "</article>", "deep"),
])
def test_pages(page, expected):
    assert text_of(page) == expected


def test_hosts_decide_unmarked_pages(spark):
    rng = random.Random(3)
    menu, legal = prose(rng, 12), prose(rng, 20).replace("\n", " ")
    own = [prose(rng, 30).replace("\n", " ") for _ in range(40)]
    rows = [(i, f"https://Host.example/{i}", f"<div>{menu}</div><p>{own[i]}</p><p>{legal}</p>") for i in range(40)]
    rows += [(100, "https://other.example/", f"<div>{menu}</div><p>{own[0]}</p>"), (101, None, None), (102, None, "<p>a</p>")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("own"))
    for shard_pages in (10, 128):
        found = {r.page_id: r.text for r in pages.extract_main_text(frame, shard_pages).collect()}
        assert found == {i: own[i] for i in range(40)} | {100: menu.replace("\n", " ") + "\n" + own[0], 101: "", 102: "a"}
    assert pages.extract_main_text(frame.limit(0)).count() == 0


def test_what_marked_pages_leave_out_is_no_text_of_unmarked_ones(spark):
    """On hosts of one page that marks nothing: what others have in menus goes, what they have in articles and what only it has stays."""
    rng = random.Random(5)
    line = lambda n: prose(rng, n).replace("\n", " ")
    menu, legal, copied, own = line(12), line(12), line(20), [line(30) for _ in range(9)]
    marked = [(i, f"https://one.example/{i}", f"<nav>{menu}</nav><article>{copied if i == 3 else own[i]}</article><footer>{legal}</footer>")
              for i in range(8)]
    plain = f"<div>{menu}</div><p>{own[8]}</p><p>{copied}</p><p>{legal}</p>"
    rows = [*marked, (8, "https://one.example/8", plain), (9, "https://two.example/", plain)]
    # Its own mark does not make it another page.
    rows.append((10, "https://three.example/", f"<nav>{menu}</nav><div>{menu}</div><p>{own[8]}</p>"))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    expected = {i: copied if i == 3 else own[i] for i in range(8)} | {
        8: f"{own[8]}\n{copied}", 9: f"{menu}\n{own[8]}\n{copied}\n{legal}", 10: f"{menu}\n{own[8]}"}
    for shard_pages in (2, 128):
        assert {r.page_id: r.text for r in pages.extract_main_text(frame, shard_pages).collect()} == expected


def plain_article(page):
    """The article of a generated page, found by its tags alone."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_page_query(spark):
    rows = {r.page_id: r for r in queries()["op8_page_text"](spark, SF).collect()}
    given = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert rows.keys() == given.keys()
    for i, r in rows.items():
        assert r.text == plain_article(given[i].html) and r.n_chars == len(r.text) and r.url == given[i].url


def test_suffixes_find_what_pages_share():
    import numpy as np

    words = [1, 2, 3, 4, 5, -1, 9, 2, 3, 4, 8, -2, 2, 3, 7, -3]
    owner = [0] * 6 + [1] * 6 + [2] * 4
    hit = pages.repeated(np.array(words), np.array(owner), long=3)
    assert [w for w, h in zip(words, hit) if h] == [2, 3, 4, 2, 3, 4]
    # Repeated on one page only.
    assert not pages.repeated(np.array([1, 2, 3, 1, 2, 3, -1]), np.zeros(7, dtype=int), long=3).any()


def test_suffix_array_is_sorted_beyond_the_least_length():
    import numpy as np

    rng = random.Random(6)
    for _ in range(500):
        words, owner = [], []
        for page in range(rng.randint(0, 5)):
            run = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 20))]
            words, owner = [*words, *run, -1 - page], [*owner, *[page] * (len(run) + 1)]
        order, common = pages.suffix_array(np.array(words, dtype=np.int64))
        expected = sorted(range(len(words)), key=lambda i: words[i:])
        assert order.tolist() == expected
        for k, (i, j) in enumerate(zip(expected, expected[1:]), 1):
            alike = [a == b for a, b in zip(words[i:], words[j:])]
            assert common[k] == (alike.index(False) if False in alike else len(alike))
        long, held = rng.randint(1, 4), {}
        for i in range(len(words) - long + 1):
            held.setdefault(tuple(words[i:i + long]), []).append(i)
        shared = {i + d for v in held.values() if len({owner[i] for i in v}) > 1 for i in v for d in range(long)}
        assert set(np.flatnonzero(pages.repeated(np.array(words), np.array(owner), long)).tolist()) == shared


TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|math|select|button|object)\b"
    r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?][^>]*>",
    re.S | re.I,
)


def test_tags_are_those_of_one_pattern():
    rng = random.Random(3)
    parts = """< > " ' / ! -- --> <!-- <script </script <p </p <nav <titles <title-x <b </b> <SVG ? a= word""".split() + [" "]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        expected = [(t.start(), t.end(), t["name"] and t["name"].lower(), bool(t["end"]), t["rest"] or "") for t in TAG.finditer(page)]
        assert list(pages.tags(page)) == expected, page


@pytest.mark.parametrize("page", [
    '<x "' * 250_000, '<a "' * 250_000 + "'>", "<!" * 500_000, "<script>" + "</script " * 100_000,
    "<div>" * 100_000 + "</b>" * 100_000, "<a " + "class=" * 150_000 + ">",
])
def test_a_page_of_a_megabyte_takes_seconds(page):
    start = time.monotonic()
    pages.blocks_of(page)
    assert time.monotonic() - start < 10


def test_unique_runs_of_a_block_stay():
    rng = random.Random(4)
    shared, own = prose(rng, 12), [prose(rng, 6) for _ in range(2)]
    assert pages.unique_texts([[f"{shared} {own[0]}"], [f"{own[1]} {shared}"]]) == own
    # Against all pairs of windows, over blocks that mix shared and own runs.
    runs = [prose(rng, rng.randint(5, 14)) for _ in range(4)]
    host = [[" ".join(rng.choice([*runs, prose(rng, rng.randint(1, 6))]) for _ in range(3)) for _ in range(rng.randint(0, 3))]
            for _ in range(12)]
    streams = [[w for block in page for w in block.split()] for page in host]
    windows = [{tuple(t[i:i + pages.LONG]) for i in range(len(t) - pages.LONG + 1)} for t in streams]
    expected = []
    for n, (page, tokens) in enumerate(zip(host, streams, strict=True)):
        others = set().union(*(w for m, w in enumerate(windows) if streams[m] != tokens))
        gone = {i + d for i in range(len(tokens)) if tuple(tokens[i:i + pages.LONG]) in others for d in range(pages.LONG)}
        at, lines = 0, []
        for block in page:
            words = block.split()
            here = "".join("x" if i in gone else "." for i in range(at, at + len(words)))
            # Short runs stay, unless they are the block.
            here = here if "." not in here else re.sub(r"x+", lambda m: m[0] if len(m[0]) >= pages.LONG else "." * len(m[0]), here)
            lines.append(" ".join(w for w, mark in zip(words, here, strict=True) if mark == "."))
            at += len(words)
        expected.append("\n".join(filter(None, lines)))
    assert pages.unique_texts(host) == expected


# ---- toxicity -------------------------------------------------------------------

def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    rows = queries()["op9_toxicity"](spark, sf)
    told = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r.n for r in told.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    right, missed, wrong = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert right / (right + missed) > 0.88 and right / (right + wrong) > 0.9
    assert rows.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").isEmpty()


def labelled(spark, n):
    """Texts of which every third has one of three bad words often."""
    rng = random.Random(12)
    texts, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split(" ")
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("gruesomeword", "vilething", "nastiness")))
        texts.append(" ".join(words))
        labels.append((i, int(rng.random() < 0.9), int(bad)))
    return texts, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_scores_of_odd_rows(spark, documents, clashing, odd_texts):
    texts, labels = labelled(spark, 300)
    base = documents([*texts, *[(1000 + (i or 0) if i is not None else None, t) for i, t in odd_texts]])
    given = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None), (6, None, 7), (1001, 0, 0)], labels.schema))
    rows = toxicity.toxicity(clashing(base), given.withColumn("text", F.lit("own"))).select("doc_id", "held_out", "toxicity").collect()
    assert len(rows) == 300 + len(odd_texts)
    assert all((r.toxicity >= 0.5) == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert all(r.toxicity < 0.5 for r in rows if r.doc_id is None or r.doc_id >= 1000)
    assert toxicity.toxicity(base.limit(0), given).count() == 0
    assert {r.toxicity for r in toxicity.toxicity(base, labels.limit(0)).collect()} == {0.0}


def test_held_out_labels_play_no_part(spark, documents):
    texts, labels = labelled(spark, 200)
    docs = documents(texts)
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs, labels).collect()}
    two = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs, turned).collect()}
    assert one == two


# ---- pipeline -------------------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic documents, shared passages, near copies, secrets and clean documents, with labels."""
    rng = random.Random(20)
    texts, labels = labelled(spark, 150)
    texts = [t if i % 3 else t for i, t in enumerate(texts)]
    passage = prose(rng, 72)
    kinds = {}
    for n in range(30):
        kinds[len(texts)] = "passage"
        texts.append(prose(rng, 24) + "\n" + passage + "\n" + prose(rng, 24))
    base = prose(rng, 240).replace("\n", " ")
    for n in range(12):
        kinds[len(texts)] = "near"
        texts.append(varied(rng, base, 2) if n else base)
    for n in range(5):
        kinds[len(texts)] = "secret"
        texts.append(prose(rng, 40) + f" password = abcdefghijkl{n:04d} " + prose(rng, 20))
    for n in range(20):
        kinds[len(texts)] = "clean"
        texts.append(prose(rng, rng.randint(15, 400)))
    texts += ["", None]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, texts, kinds


def plain_kept(texts):
    """The smallest id of each class that links of word shingles make, by all pairs."""
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if least[i] < least[j] and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    least[j], changed = least[i], True
    return [i for i in sets if least[i] == i]


def test_near_copies_leave_one_document(spark, corpus):
    """On documents whose lines were not deduplicated, near copies are one class."""
    import corpus_pipeline

    folder, texts, kinds = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    near = [i for i, kind in kinds.items() if kind == "near"]
    left = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).select("doc_id").collect()}
    assert left & set(near) == {near[0]} and left == set(plain_kept(dict(enumerate(texts))))


def test_pipeline_stage_by_stage(spark, corpus):
    import corpus_pipeline

    folder, texts, kinds = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            rows = docs.collect()
            assert all(r.n_chars == len(r.text or "") and r.source == f"src{r.doc_id % 3}" for r in rows)
            kept[name] = {r.doc_id: r.text for r in rows}
    toxic = {i for i in range(150) if i % 3 == 0}
    assert kept["toxicity"] == {i: t for i, t in enumerate(texts) if i not in toxic}
    plain = plain_dedup(kept["toxicity"].items())
    assert {i: t for i, t in kept["line dedup"].items() if t} == {i: t for i, t in plain.items() if t.strip()}
    assert kept["near dedup"] == {i: kept["line dedup"][i] for i in plain_kept(kept["line dedup"])}
    for i, t in kept["secrets"].items():
        assert not plain_spans(t or "")
        if kinds.get(i) == "secret":
            assert t == re.sub(r"password = abcdefghijkl\d{4}", "[secret]", texts[i])
        else:
            assert t == kept["near dedup"][i]
    check_packing(docs.collect(), list(kept["secrets"].items()))


def test_pipeline_query(spark, corpus):
    import __spark_entry__ as entry

    folder, *_ = corpus
    packed = spark.read.parquet(f"{folder}/packing")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    mine = entry.queries()["pipeline"](spark, folder)
    assert sorted(map(tuple, mine.select(names).collect())) == sorted(map(tuple, packed.select(names).collect()))


def test_pipeline_of_odd_rows(spark, documents, clashing, odd_texts, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd_texts, []):
        docs = clashing(documents(rows))
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{tmp_path}/{len(rows)}-{n}"
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
        assert (docs.count() > 0) == bool(rows)
