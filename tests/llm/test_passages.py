"""Passages beside a version that compares every window of every document."""

import random
import re
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import clashing, documents, odd_texts, prose  # noqa: F401

from riskweave.llm import linededup, passages, runs


def plain_passages(pairs, window=50, least=10):
    """Words of each document in a window that a smaller doc_id has too, by a table of all windows."""
    first, out = {}, {}
    for doc_id, text in sorted((i, t or "") for i, t in pairs):
        words = text.split()
        gone = [False] * len(words)
        for at in range(max(1, len(words) - window + 1) if len(words) >= least else 0):
            run = tuple(words[at:at + window])
            if first.setdefault(run, doc_id) < doc_id:
                gone[at:at + len(run)] = [True] * len(run)
        out[doc_id] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def plain_dedup(pairs, line_words=4, block_words=10, window=50):
    """What is left of each text: lines go that lie in a shortest run of enough words that a smaller doc_id has, and so do words in a window that one has."""
    runs, windows, out = {}, {}, {}
    for doc_id, text in sorted((i, t or "") for i, t in pairs):
        gone = bytearray(len(text))
        parts = list(re.finditer(r"(?<=[.!?])\s+|\n\s*", text))
        edges = zip([0, *(m.end() for m in parts)], [*(m.start() for m in parts), len(text)], [*(m.end() for m in parts), len(text)])
        lines = [(a, z, text[a:b].strip(), len(text[a:b].split())) for a, b, z in edges if len(text[a:b].split()) >= line_words]
        n = len(lines)
        for at in range(n):
            for places in (range(at, n), range(at, -1, -1)):
                words = 0
                for last in places:
                    words += lines[last][3]
                    if words >= block_words:
                        run = lines[min(at, last):max(at, last) + 1]
                        if runs.setdefault(tuple(x[2] for x in run), doc_id) < doc_id:
                            for a, z, *_ in run:
                                gone[a:z] = b"x" * (z - a)
                        break
        words = [*re.finditer(r"\S+", text)]
        starts = [*(m.start() for m in words), len(text)]
        for at in range(max(1, len(words) - window + 1) if len(words) >= block_words else 0):
            end = min(at + window, len(words))
            if windows.setdefault(tuple(m.group() for m in words[at:end]), doc_id) < doc_id:
                gone[starts[at]:starts[end]] = b"x" * (starts[end] - starts[at])
        out[doc_id] = "".join(c for c, g in zip(text, gone, strict=True) if not g)
    return out


def text_left(documents, texts):
    return {r.doc_id: r.text for r in passages.dedup_passages(documents(texts)).collect()}


def words_left(found):
    return {i: (t or "").split() for i, t in found.items()}


def test_a_passage_goes_from_its_first_to_its_last_word(documents):
    rng = random.Random(31)
    line = lambda n: prose(rng, n).replace("\n", " ")
    passage = line(30) + ". " + line(20) + ". " + line(15)
    texts = [line(20) + " " + passage + " " + line(20) for _ in range(3)]
    single = line(60)
    texts += [line(7) + " " + single + " " + line(9) for _ in range(3)]
    texts += [single[1:], "tail " + " ".join(single.split()[:50]), "other " + " ".join(single.split()[:49])]
    found = words_left(text_left(documents, texts))
    assert found == plain_passages(list(enumerate(texts)))
    assert [len(found[i]) for i in range(len(texts))] == [105, 40, 40, 76, 16, 16, 1, 1, 50]


def test_every_window_is_compared_with_its_first_holder(documents):
    rng = random.Random(33)
    words = prose(rng, 400).split()
    texts = []
    for n in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(350)
            parts += words[a:a + rng.randint(30, 90)] + prose(rng, rng.randint(0, 20)).split()
        texts.append(" ".join(parts))
    texts += ["same " * 500, "same " * 300, " ".join(words[:200]) * 2]
    docs = documents(texts)
    found = passages.repeated_passages(linededup.units(docs, linededup.LineDedup(), 50), docs).groupBy("doc_id").agg(F.collect_set("span"))
    cut = {r[0]: r[1] for r in found.collect()}
    plain = plain_passages(list(enumerate(texts)))
    for n, text in enumerate(texts):
        assert runs.without(text.encode(), np.array(cut.get(n, []), dtype=np.int64)).decode().split() == plain[n]


@pytest.mark.parametrize("chunk", [1, 400, 1 << 18])
def test_words_lines_and_runs_of_lines(monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    rng = random.Random(37)
    blanks = [" ", "  ", "\n", " \n ", ". ", "! \n", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "\u200b", "\u00e9", "\u4e2d"]
    texts = ["".join(rng.choice(["a", "be", "\u00fcn", "\u20ac", *blanks]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    got = []
    for row, end, words in runs.chunks_of(pa.array(texts), runs.Hashing()):
        found = {k: v.to_pylist() for k, v in runs.line_arrays(words, 2, 5).items()}
        for n in range(end - row):
            raw = texts[row + n].encode()
            a, z = words.first[n], words.first[n + 1]
            assert [raw[s:e].decode() for s, e in zip(words.starts[a:z] - words.bounds[n], words.ends[a:z] - words.bounds[n])] == texts[row + n].split()
            got.append([[x >> 32, x & 0xFFFFFFFF] for x in found["spans"][n]])
            sizes = [len(raw[s:e].split()) if raw.isascii() else len(raw[s:e].decode().split()) for s, e in got[-1]]
            assert found["words"][n] == sizes
            wanted = set()
            for i in range(len(sizes)):
                for places in (range(i, len(sizes)), range(i, -1, -1)):
                    reach = [j for j in places if sum(sizes[min(i, j):max(i, j) + 1]) >= 5]
                    wanted |= {(min(i, j), max(i, j) + 1) for j in reach[:1]}
            assert set(zip(found["starts"][n], found["ends"][n])) == wanted
    for text, spans in zip(texts, got, strict=True):
        parts = list(re.finditer(r"(?<=[.!?])\s+|\n\s*", text))
        edges = zip([0, *(m.end() for m in parts)], [*(m.start() for m in parts), len(text)], [*(m.end() for m in parts), len(text)])
        assert spans == [[len(text[:a].encode()), len(text[:z].encode())] for a, b, z in edges if len(text[a:b].split()) >= 2]


def test_passages_of_odd_rows(documents, clashing, odd_texts):
    found = passages.dedup_passages(clashing(documents(odd_texts))).collect()
    assert len(found) == len(odd_texts)
    text = odd_texts[3][1]
    assert all(r.text == text for r in found if r.doc_id == 3)
    assert all(r.text in (None, text) for r in found if r.doc_id is None)
    assert {r.doc_id: r.text for r in found if r.doc_id in (0, 4, 10)} == {0: None, 4: "", 10: ""}
    assert all(r.rep == "own rep" for r in found)
    assert passages.dedup_passages(documents([])).count() == 0


def test_short_sentences_and_list_lines_go(documents):
    rng = random.Random(36)
    short = [prose(rng, 3).capitalize() for _ in range(20)]
    texts = [". ".join(short) + ".", ". ".join(short) + ".", "\n".join(short), prose(rng, 20) + "\n" + "\n".join(short[:17])]
    texts += ["\n".join(short[3:8]), "\n".join(short[3:8])]
    texts += ["one two\u00a0three\u00a0four\u00a0five six\u00a0seven eight nine ten\n" + prose(rng, 9) for _ in range(2)]
    texts += ["a\tb\tc\td\te\tf\tg\th\ti\tj\n" + prose(rng, 9) for _ in range(2)]
    texts[2] = texts[2].replace("\n", ".\n") + "."
    found = words_left(text_left(documents, texts))
    assert [len(found[i]) for i in range(len(texts))] == [60, 0, 0, 71, 15, 0, 19, 9, 19, 9]


# ---- blocks of lines --------------------------------------------------------------

def plain_blocks(pairs, line_words=4, block_words=10):
    """Lines of each document that do not lie in a run of enough words that a smaller doc_id has too, by all runs."""
    first, out = {}, {}
    for doc_id, text in sorted(pairs):
        lines = [x.strip() for x in text.split("\n") if len(x.split()) >= line_words]
        gone = set()
        for start in range(len(lines)):
            for end in range(start + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[start:end]) >= block_words:
                    if first.setdefault(tuple(lines[start:end]), doc_id) < doc_id:
                        gone.update(range(start, end))
        out[doc_id] = [x for n, x in enumerate(lines) if n not in gone]
    return out


def lines_left(documents, texts):
    return {r.doc_id: [x for x in r.text.split("\n") if len(x.split()) >= 4] for r in linededup.dedup_lines(documents(texts)).collect()}


def test_repeated_and_turned_blocks_go():
    a, b, c = [(n, h, 5) for n, h in enumerate("xyz")], [(n, h, 5) for n, h in enumerate("xyzxyz")], [(n, h, 10) for n, h in enumerate("zyx")]
    assert set(linededup.common_blocks(a, b, 10)) == set(range(6))
    assert set(linededup.common_blocks(b, a, 10)) == set(range(3))
    assert set(linededup.common_blocks([(n, h, 10) for n, h in enumerate("xyz")], c, 10)) == set(range(3))
    assert set(linededup.common_blocks(a, [(n, h, 5) for n, h in enumerate("zyx")], 10)) == set()


def test_blocks_of_every_pair_equal_all_runs(documents):
    rng = random.Random(34)
    pool = [" ".join(prose(rng, rng.randint(4, 12)).split()) for _ in range(9)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(60)]
    assert lines_left(documents, texts) == plain_blocks(list(enumerate(texts)))


def test_a_block_is_found_in_whichever_document_holds_it(documents):
    rng = random.Random(35)
    one, two = (" ".join(prose(rng, 6).split()) for _ in range(2))
    own = lambda: " ".join(prose(rng, 30).split())
    texts = [f"{own()}\n{one}\n{own()}", f"{own()}\n{two}\n{own()}"] + [f"{own()}\n{one}\n{two}\n{own()}" for _ in range(20)]
    found = lines_left(documents, texts)
    assert found == plain_blocks(list(enumerate(texts)))
    assert [len(found[i]) for i in range(22)] == [3, 3, 4] + [2] * 19


def test_texts_are_cut_without_a_sort(spark, documents):
    plan = passages.dedup_passages(documents([(1, "one two three four. " * 30)]))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_units_are_gone_once_nothing_reads_them(spark, documents):
    def stored_units():
        return set(Path(spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).glob("units-*"))

    before = stored_units()
    words = prose(random.Random(3), 200).split()
    texts = [" ".join(words), " ".join(words[50:150]), "Something else."]
    left = [passages.dedup_passages(documents(texts)), linededup.dedup_lines(documents([texts[0], texts[0]]))]
    assert stored_units() == before
    assert {r.doc_id: r.text.strip() for r in left[0].collect()} == {0: texts[0], 1: "", 2: texts[2]}
    assert left[1].count() == 2
