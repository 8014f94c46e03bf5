"""Packing, token files and BPE beside the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from samples import SF, clashing, documents, odd_texts  # noqa: F401

from riskweave.llm import binary, bpe, packing, tokens
from riskweave.llm.queries import queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.text(alphabet=st.sampled_from("aAbBçÉñßéêst '!?.,<|>12²\n\t́İ🙂日ΣσK \x1c"), max_size=80)


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_pieces_give_the_librarys_ids(path, text):
    assert tokens.encoder(path).encode(text) == as_bytes(
        Tokenizer_of(path).encode(text, add_special_tokens=False).ids)


_known = {}


def Tokenizer_of(path):
    return _known.setdefault(path, Tokenizer.from_file(path))


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_segment_trees_give_the_librarys_ids(text):
    library = Tokenizer_of(WORDS)
    ids = library.encode(text, add_special_tokens=False).ids
    mine = bpe.codec(WORDS).encode([text])[0]
    assert mine == ids
    assert bpe.codec(WORDS).decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_segment_trees_on_long_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (1, 2, 3, 17, 64, 65, 5000)] + ["ab" * 3000, "x" * 4097]
    library = Tokenizer_of(WORDS)
    assert bpe.codec(WORDS).encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_query_equals_the_library(spark):
    rows = queries()["op7_bpe"](spark, SF).collect()
    library = Tokenizer_of(WORDS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("odd", [False, True])
def test_bpe_on_odd_rows(documents, clashing, odd_texts, odd):
    docs = documents(odd_texts if odd else [])
    rows = bpe.encode_texts(clashing(docs), WORDS).collect()
    library = Tokenizer_of(WORDS)
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in (odd_texts if odd else [])]
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in rows) == sorted((i is None, i, x) for i, x in expected)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_values_survive_packing(values):
    array = np.array(values, dtype=np.uint32)
    control, octets = binary.pack(array)
    assert len(control) == -(-len(values) // 4)
    assert binary.unpack(control, octets, len(values)).tolist() == values


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=20))
def test_halves_are_whole_again(values):
    assert binary.whole(binary.halves(as_bytes(values))).tolist() == values


def check_files(spark, docs, rows, pairs):
    library = Tokenizer_of(WORDS)
    at, expected = 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(as_bytes(ids))))
        at += len(ids)
    return sorted(rows, key=lambda r: r[1]), expected


def test_token_files_query(spark):
    rows = [tuple(r) for r in queries()["op5_token_files"](spark, SF).collect()]
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    mine, expected = check_files(spark, None, rows, pairs)
    assert mine == expected


def test_token_files_on_odd_rows(spark, documents, clashing, odd_texts, tmp_path):
    from riskweave.session import scratch_dir

    folder = scratch_dir(spark, "test-files")
    docs = clashing(documents(odd_texts))
    rows = [tuple(r) for r in binary.round_trip(docs, WORDS, 2, folder).collect()]
    mine, expected = check_files(spark, docs, rows, odd_texts)
    # Rows of one doc_id come in any order.
    assert sorted((r[0] is None, r[0], r[2], r[3]) for r in mine) == sorted((r[0] is None, r[0], r[2], r[3]) for r in expected)
    assert [r[0] for r in mine] == [r[0] for r in expected]
    assert all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:]))
    back = binary.read_files(spark, folder).collect()
    assert sum(len(r.ids) // 4 for r in back) == sum(r[2] for r in mine)
    assert binary.round_trip(documents([]), WORDS, 2).count() == 0


def check_packing(rows, pairs, room=1024):
    library = Tokenizer_of(BYTES)
    expected = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
        expected += [(i, n, a, b - a, zlib.crc32(as_bytes(ids[a:b]))) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(sequences), np.array([e[3] for e in expected])


def test_packing_query(spark):
    rows = queries()["op1_best_fit_packing"](spark, SF).collect()
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, lengths = check_packing(rows, pairs)
    assert used <= 1.02 * packing.lower_bound(lengths, 1024) + 1


def test_packing_on_odd_rows_and_islands(documents, clashing, odd_texts):
    how = packing.Evolution(shard_items=6, islands=3, epochs=3)
    check_packing(packing.pack_documents(clashing(documents(odd_texts)), BYTES, how=how).collect(), odd_texts)
    assert packing.pack_documents(documents([]), BYTES).count() == 0


def test_evolution_beats_best_fit_on_triplets():
    # Three pieces fill a sequence exactly; best fit alone wastes some.
    rng = random.Random(2)
    sizes = []
    for _ in range(60):
        a = rng.randint(380, 490)
        b = rng.randint(258, (1024 - a) - 258)
        sizes += [a, b, 1024 - a - b]
    start = packing.Packing(sizes, 1024).place_all(list(range(len(sizes))))
    how = packing.Evolution(children=300, population=12)
    best = packing.evolve(sizes, 1024, [], 3, how)[0]
    assert len(best.bins) < len(start.bins)
    assert sorted(i for items in best.bins for i in items) == list(range(len(sizes)))
    assert packing.lower_bound(np.array(sizes), 1024) == 60


def evolved(sizes, how):
    """Bins of the best packing of one shard, by island, as `pack_items` evolves them."""
    best = [packing.evolve(sizes, 1024, [], hash((0, i)), how)[:how.elites] for i in range(how.islands)]
    for epoch in range(1, how.epochs):
        best = [packing.evolve(sizes, 1024, best[i] + best[i - 1], hash((epoch, 0, i)), how)[:how.elites]
                for i in range(how.islands)]
    return min(len(b[0].bins) for b in best)


def test_production_size_finds_better_packings():
    import corpus_pipeline

    rng = random.Random(2)
    sizes = []
    for _ in range(60):
        a = rng.randint(380, 490)
        b = rng.randint(258, (1024 - a) - 258)
        sizes += [a, b, 1024 - a - b]
    little = packing.Evolution(islands=2, epochs=2, population=3, children=4, elites=1)
    assert evolved(sizes, packing.Evolution()) < evolved(sizes, little)
    assert evolved(sizes, corpus_pipeline.EVOLUTION) < evolved(sizes, packing.Evolution())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_white_space_parts_pieces(path):
    ours, library, rng = tokens.encoder(path), Tokenizer_of(path), random.Random(5)
    parts = ["a", "It's", "'s", "'ll", " ", "  ", "\n", "\t", " \n", "\r\n", "12", "3x", "...", "don't!", "é", "—", "_", "\"", "'"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert ours.encode(text) == as_bytes(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_usual_characters_are_those_that_are_not_unusual():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        assert bool(tokens.USUAL.fullmatch(c)) != bool(tokens.UNUSUAL.search(c)), repr(c)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_new_pieces_of_any_bytes(path):
    library = Tokenizer_of(path)
    for text in ["a b", "a  b", "\tx\n", "é", " é", "\x7f", "\x0b", "'s", "²", ""]:
        assert tokens.Encoder(path).encode(text) == as_bytes(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_packings_share_bins_that_nothing_is_added_to():
    sizes = [600, 424, 500, 300]
    one = packing.Packing(sizes, 1024)
    full, open_ = [0, 1], [2]
    one.add_bin(full)
    one.add_bin(open_)
    one.place_all([3])
    assert one.bins == [[0, 1], [2, 3]]
    assert one.bins[0] is full
    assert open_ == [2]
    # An item of no length fits into a full bin, so that one is not shared.
    other = packing.Packing([600, 424, 0], 1024)
    other.add_bin(full)
    assert other.place_all([2]).bins == [[0, 1, 2]]
    assert full == [0, 1]
