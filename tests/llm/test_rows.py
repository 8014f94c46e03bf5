"""Rows that repeat others, in pages of a host and in the pipeline."""

import random

from samples import clashing, documents, odd_texts, prose  # noqa: F401

from riskweave.llm import pages


def test_boilerplate_does_not_depend_on_shards(spark):
    rng = random.Random(41)
    line = lambda n: " ".join(prose(rng, n).split())
    notice = line(20)
    rows = []
    for n in range(300):
        own = [line(15), line(12)]
        rows.append((n, f"http://hot.example/{n}", own + [notice] * (n in (3, 250))))
    rows += [(n, f"http://hot.example/copy{n}", rows[7][2]) for n in range(300, 303)]
    frame = spark.createDataFrame(
        [(i, url, "".join(f"<p>{b}</p>" for b in blocks)) for i, url, blocks in rows], "page_id bigint, url string, html string")
    expected = {i: "\n".join(b for b in blocks if b != notice) for i, _, blocks in rows}
    for shard_pages in (2, 40, 1000):
        assert {r.page_id: r.text for r in pages.extract_main_text(frame, shard_pages).collect()} == expected


def test_repeated_rows_are_kept_once(spark, documents, clashing, odd_texts):
    import corpus_pipeline

    docs = clashing(documents(odd_texts + odd_texts[:9]))
    found = [(r.doc_id, r.text or "") for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert len(found) == len(set(found)) > 5
    text = odd_texts[3][1]
    assert found.count((3, text)) == 1 and (4, text) not in found
