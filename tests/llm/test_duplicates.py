"""Near duplicates, fingerprints and line dedup beside plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from samples import SF, clashing, documents, odd_texts, prose, varied  # noqa: F401

from riskweave.llm import fingerprints as fp
from riskweave.llm import linededup, neardup
from riskweave.llm.components import components
from riskweave.llm.queries import queries
from riskweave.llm.shingles import Shingler


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text, k):
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def classes(sets, percent=80):
    """Smallest index reachable from each set, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_shingles_count_as_plain_sets(odd_texts):
    texts = [t or "" for _, t in odd_texts] + ["a B c", "A b C", "a  b\tc", "x y z w v", "x y z w"]
    for k in (4, 5):
        mine = Shingler(k).sets(texts)
        plain = [shingles(t, k) for t in texts]
        assert [len(s) for s in mine] == [len(s) for s in plain]
        for i, a in enumerate(plain):
            for j, b in enumerate(plain):
                assert len(set(mine[i].tolist()) & set(mine[j].tolist())) == len(a & b)


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    text = prose(rng, 600)
    a, b = neardup.multipliers()
    for edits in (0, 5, 30, 100):
        one, two = Shingler(5).sets([text, varied(rng, text, edits)])
        exact = len(set(one.tolist()) & set(two.tolist())) / len(set(one.tolist()) | set(two.tolist()))
        signs = [neardup.signature(neardup.minima(s, a, b)) for s in (one, two)]
        assert abs(float(neardup.estimate(*signs)) - exact) < 0.13


def family(rng, copies, most_edits):
    base = prose(rng, 150)
    return [varied(rng, base, rng.randint(0, most_edits)) for _ in range(copies)]


@pytest.mark.parametrize("small", [False, True])
def test_classes_equal_all_pairs(documents, small):
    rng = random.Random(6)
    texts = family(rng, 60, 9) + family(rng, 25, 5) + [prose(rng, 80) for _ in range(20)]
    texts += [texts[3]] * 6 + ["", "one", "one", "one two three"]
    rng.shuffle(texts)
    # Small bounds lead through the paths for large buckets and clusters.
    how = neardup.NearDup(bucket_rows=4, block_rows=8, centres=2, rest_rows=3) if small else neardup.NearDup()
    rows = {r.doc_id: r for r in neardup.near_duplicates(documents(texts), how).collect()}
    sets = [shingles(t, 5) for t in texts]
    assert {i: r.component_id for i, r in rows.items()} == dict(enumerate(classes(sets)))
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in rows.items())


def test_near_duplicates_of_odd_rows(documents, clashing, odd_texts):
    rows = neardup.near_duplicates(clashing(documents(odd_texts))).collect()
    assert len(rows) == len(odd_texts)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by_id[3] + by_id[4] + by_id[5] + by_id[10]} == {3}
    assert all(r.component_id == i for i in (0, 1, 2, 6, 7, 9) for r in by_id[i])
    assert all(r.kept and r.component_id is None for r in by_id[None])
    assert neardup.near_duplicates(documents([])).count() == 0


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000 + i, 6000 + i) for i in range(50)]
    rng.shuffle(edges)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}
    expected |= {x: 5000 + i for i in range(50) for x in (5000 + i, 6000 + i)}
    assert found == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- fingerprints ---------------------------------------------------------------

def plain_edited(texts):
    """Edited texts of rows in order."""
    out = []
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        out.append(t[:len(t) - half] + following[:half])
    return out


def test_fingerprint_query(spark):
    rows = {r.doc_id: r for r in queries()["op3_fingerprints"](spark, SF).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    edited = plain_edited([t for _, t in docs])
    prints = {}
    for (i, text), other in zip(docs, edited):
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(other, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    long = [r for r in rows.values() if r.n_chars >= 300]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)


def test_fingerprints_run_no_python(spark):
    plan = queries()["op3_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("rows_per_bucket", [2, 2000])
def test_next_rows_over_ranges(documents, rows_per_bucket):
    docs = documents([(3 * i, f"text {i}") for i in range(23)]).select("doc_id", "text")
    found = {r.doc_id: r.next_text for r in fp.with_next(docs, ["text"], rows_per_bucket).collect()}
    assert found == {3 * i: f"text {(i + 1) % 23}" for i in range(23)}


def test_fingerprints_of_odd_rows(documents, clashing, odd_texts):
    rows = fp.edited_fingerprints(clashing(documents(odd_texts))).collect()
    assert len(rows) == len(odd_texts)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.n_chars if r.n_chars == 0 else (r.n_chars, r.fingerprint), set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert fp.edited_fingerprints(documents([])).count() == 0
    one = fp.edited_fingerprints(documents(["one two three four"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"one two tone two t").hexdigest()


def test_paragraphs_are_added_and_taken_out(spark):
    rows = [("a b c d e f g\nsecond one here\nthird", "third\na b c d e f g", "second one here"),
            ("x\nx\ny z", "x\ny z", "x"), ("only one\n", "", "only one")]
    frame = spark.createDataFrame(rows, "whole string, part string, rest string").select(
        *[fp.vector(F.col(c)).alias(c) for c in ("whole", "part", "rest")])
    told = frame.select(
        (fp.add(F.col("part"), F.col("rest")) == F.col("whole")).alias("added"),
        (fp.add(F.col("whole"), F.col("rest"), -1) == F.col("part")).alias("taken"),
        (fp.fingerprint(F.col("whole")) != fp.fingerprint(F.col("part"))).alias("differ")).collect()
    assert all(r.added and r.taken and r.differ for r in told)


# ---- line dedup -----------------------------------------------------------------

def cut_lines(text, how):
    """Parts of a text, lines and what parts them in turn, and the places of lines with enough words."""
    parts = re.split(r"((?<=[.!?])\s+|\n\s*)", text)
    return parts, [n for n in range(0, len(parts), 2) if len(parts[n].strip().split(" ")) >= how.line_words]


def plain_lines(pairs, how):
    """Line dedup of (doc_id, text) in ascending doc_id, by comparing each document with all that share a line."""
    docs = sorted((i, t or "") for i, t in pairs)
    cut = {i: cut_lines(t, how) for i, t in docs}
    lines = {i: [(n, parts[at].strip(), len(parts[at].strip().split(" "))) for n, at in enumerate(places)]
             for i, (parts, places) in cut.items()}
    held = {}
    for i, ls in lines.items():
        for _, line, _ in ls:
            held.setdefault(line, {}).setdefault(i)
    pairs = set()
    for owners in map(sorted, held.values()):
        pairs |= {(owners[0], later) for later in owners[1:]}
        pairs |= set(zip(owners, owners[1:]))
    shared = {i: [x for x in ls if len(held[x[1]]) > 1] for i, ls in lines.items()}
    gone = {i: set() for i, _ in docs}
    for earlier, later in pairs:
        gone[later] |= set(linededup.common_blocks(shared[earlier], shared[later], how.block_words))
    out = {}
    for i, (parts, places) in cut.items():
        drop = {p for n in gone[i] for p in (places[n], places[n] + 1)}
        out[i] = "".join(part for n, part in enumerate(parts) if n not in drop)
    return out


def mixed(rng, passages, n):
    """A document with passages among lines of its own."""
    parts = [prose(rng, rng.randint(5, 40)) for _ in range(n)] + rng.sample(passages, rng.randint(0, 2))
    rng.shuffle(parts)
    return "\n".join(parts)


def test_line_dedup_equals_plain_version(documents):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (60, 75, 24, 8, 4)]
    texts = [mixed(rng, passages, 3) for _ in range(40)]
    texts += [texts[0], texts[1], texts[2] + "\n" + prose(rng, 30), "\n\n".join(texts[5].split("\n")), passages[0]]
    sentences = ". ".join(prose(rng, 9).replace("\n", " ") for _ in range(8)) + "."
    texts += [prose(rng, 30) + " and " + sentences + " " + prose(rng, 30) for _ in range(3)]
    how = linededup.LineDedup()
    found = linededup.dedup_lines(documents(texts), how).collect()
    expected = plain_lines(list(enumerate(texts)), how)
    assert {r.doc_id: r.text for r in found} == expected
    assert all(r.removed_chars == len(texts[r.doc_id]) - len(r.text) for r in found)
    # A passage inside a paragraph goes, but for its first, broken sentence.
    assert [sentences[20:] in r.text for r in sorted(found)[-3:]] == [True, False, False]
    assert all(". ".join(sentences.split(". ")[1:]) not in r.text for r in sorted(found)[-2:])
    for passage in passages[:2]:  # each stays in one document
        assert sum(passage in r.text for r in found) <= 1
        assert any(passage.split("\n")[0] in r.text for r in found if passage in texts[r.doc_id])


def test_clean_documents_keep_their_lines(documents):
    rng = random.Random(10)
    texts = [prose(rng, 100) + "\nYes.\nNo, it is not at all. So we said." for _ in range(10)]
    assert {r.doc_id: r.text for r in linededup.dedup_lines(documents(texts)).collect()} == dict(enumerate(texts))


def test_line_dedup_of_odd_rows(documents, clashing, odd_texts):
    found = linededup.dedup_lines(clashing(documents(odd_texts))).collect()
    assert len(found) == len(odd_texts)
    text = odd_texts[3][1]
    assert all(r.text == text for r in found if r.doc_id == 3)
    assert all(r.text in (None, text) for r in found if r.doc_id is None)
    assert [r.text for r in found if r.doc_id == 4] == [""]
    assert [r.text for r in found if r.doc_id == 0] == [None]
    assert all(r.rep == "own rep" for r in found)
    assert linededup.dedup_lines(documents([])).count() == 0


def test_patience_takes_unique_lines_as_anchors():
    assert linededup.align([1, 2, 3, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert linededup.align([9, 1, 2, 8], [7, 1, 2, 6]) == [(1, 1), (2, 2)]
    assert linededup.align([1, 5, 2], [2, 5, 1]) in ([(1, 1)], [(0, 2)], [(2, 0)])
    assert linededup.align([], [1]) == []
    assert linededup.align([3, 1, 3, 2, 3], [1, 3, 2]) == [(1, 0), (2, 1), (3, 2)]


def test_line_dedup_query(spark):
    from test_passages import plain_dedup

    rows = {r.doc_id: r.text for r in queries()["op4_line_dedup"](spark, SF).collect()}
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {i: t or "" for i, t in rows.items()} == plain_dedup(pairs)
