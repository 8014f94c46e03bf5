"""Byte-pair encoding and decoding with segment trees.

Every word keeps a segment tree over the ranks of its adjacent pairs. A leaf
is a pair's rank together with its place, so that the root is the leftmost
pair of lowest rank. Merging it changes three leaves and their paths; it ends
when the root holds no mergeable pair. Words of one padded length are merged
in step: their trees are rows of one array.

Words are remembered per worker, at most `REMEMBERED`. Null text is empty and
has no tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import id_number, id_text, kept, small_batches, text_or_empty
from riskweave.llm.tokens import UNUSUAL, WORD_PIECES, byte_letters

NO_PAIR = np.iinfo(np.int64).max
#: Cells of the trees that are merged in step.
CELLS = 1 << 21
REMEMBERED = 400_000


class Merges:
    """Vocabulary and ranked merges of a word-end vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.size = len(vocab)
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [(vocab[a] * self.size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted keys, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)


def merge_in_step(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge rows of symbols, padded with -1 to a power of two, until no pair of a row has a rank."""
    rows, width = symbols.shape
    symbols = np.hstack([symbols, np.full((rows, 1), -1)])  # a place to the right of all
    places = np.arange(width)
    after = np.tile(np.arange(1, width + 1), (rows, 1))
    before = np.tile(np.arange(-1, width), (rows, 1))
    at = merges.rank(symbols[:, :-1], symbols[:, 1:])
    tree = np.full((rows, 2 * width), NO_PAIR)
    tree[:, width:] = np.where(at >= 0, merges.ranks[at] * width + places, NO_PAIR)
    level = width
    while level > 1:
        level //= 2
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

    def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        node = place + width
        tree[row, node] = value
        while width > 1 and node[0] > 1:
            node = node // 2
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        found = merges.rank(symbols[row, place], symbols[row, after[row, place]])
        return np.where(found >= 0, merges.ranks[found] * width + place, NO_PAIR)

    row = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(row):
        left = tree[row, 1] % width
        right = after[row, left]
        symbols[row, left] = merges.merged[merges.rank(symbols[row, left], symbols[row, right])]
        symbols[row, right] = -1
        beyond = after[row, right]
        after[row, left] = beyond
        before[row, beyond] = left
        put(row, right, np.full(len(row), NO_PAIR))
        put(row, left, pair(row, left))
        has = before[row, left] >= 0
        if has.any():
            near, place = row[has], before[row[has], left[has]]
            put(near, place, pair(near, place))
        row = row[tree[row, 1] < NO_PAIR]
    return symbols[:, :width]


def encode_words(words: list[str], merges: Merges) -> list[list[int]]:
    """Ids of each word."""
    out: list = [None] * len(words)
    raw = [w.encode() for w in words]
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(raw):
        by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
    for width, members in by_width.items():
        step = max(1, CELLS // width)
        for start in range(0, len(members), step):
            chunk = members[start:start + step]
            sizes = np.array([len(raw[i]) for i in chunk])
            letters = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in chunk), dtype=np.uint8).reshape(-1, width)
            places = np.arange(width)
            symbols = np.where(places < sizes[:, None], merges.inner[letters], -1)
            ends = np.arange(len(chunk)), sizes - 1
            symbols[ends] = merges.last[letters[ends]]
            merged = merge_in_step(symbols, merges)
            for i, line in zip(chunk, merged, strict=True):
                out[i] = line[line >= 0].tolist()
    return out


class Codec:
    """Encodes texts and decodes ids, and remembers words."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.known: dict[str, tuple[int, ...]] = {}
        #: A word's ids in decimal and its tokens, each followed by a space.
        self.written: dict[str, str] = {}
        self.spelled: dict[str, str] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")")

    def pieces(self, text: str) -> list[str]:
        """Words of a text in the normal form of the vocabulary; special tokens stay whole."""
        if not UNUSUAL.search(text):
            return WORD_PIECES.findall(text.lower())
        found = []
        for i, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if i % 2:
                found.append(part)
            else:
                normal = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))
                # One character at a time: what stands beside it plays no part.
                lower = normal.lower() if normal.isascii() else "".join(map(str.lower, normal))
                found += self.merges.pattern.findall(lower)
        return found

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.written, self.spelled = {}, {}, {}
        for special, number in self.merges.special.items():
            self._keep(special, (number,))
        new = [w for w in new if w not in self.known]
        for word, ids in zip(new, encode_words(new, self.merges), strict=True):
            self._keep(word, tuple(ids))

    def _keep(self, word: str, ids: tuple[int, ...]) -> None:
        self.known[word] = ids
        self.written[word] = " ".join(map(str, ids)) + " "
        self.spelled[word] = self.decode(ids) + " "

    def _learned(self, texts: list[str]) -> list[list[str]]:
        """Pieces of texts, all of them known."""
        cut = [self.pieces(t) for t in texts]
        need = set().union(*cut)
        while not need <= self.known.keys():  # learning may start anew
            self.learn(need)
        return cut

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for w in pieces for i in self.known[w]] for pieces in self._learned(texts)]

    def write_out(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Ids in decimal, joined by spaces, and the text they decode to."""
        for pieces in self._learned(texts):
            yield "".join(map(self.written.__getitem__, pieces))[:-1], "".join(map(self.spelled.__getitem__, pieces))[:-1]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.merges.tokens.__getitem__, ids))


def codec(path: str) -> Codec:
    """One codec for each vocabulary file and worker."""
    return kept(("codec", path), lambda: Codec(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text that they decode to, for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = codec(path)
        for batch in batches:
            ids = words.encode(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [words.decode(x) for x in ids]})

    rows = small_batches(docs).select(id_text(), text_or_empty().alias("text"))
    return id_number(rows.mapInPandas(run, "doc_id string, ids array<int>, decoded string"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As `encode_texts`, but only the number of ids and digests of ids and decoded text leave the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = codec(path)
        for batch in batches:
            out = list(words.write_out(list(batch["text"])))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [ids.count(" ") + (ids != "") for ids, _ in out],
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in out],
                "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text in out]})

    rows = small_batches(docs).select(id_text(), text_or_empty().alias("text"))
    return id_number(rows.mapInPandas(run, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
