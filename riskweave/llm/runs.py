"""Words, lines and runs of words of texts, found in the bytes of an Arrow batch.

No Python string is made of a text: blanks, words and lines are places in the
batch's bytes, and runs of words are hashed by sums that roll over them. Texts
are taken in chunks of about `CHUNK` bytes, or one text where it is longer.
Places are bytes from the start of a text; a span is one number, its start in
the upper and its end in the lower half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of texts that are looked at together.
CHUNK = 1 << 18

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True

#: Bytes that end a sentence.
STOP = np.zeros(256, dtype=bool)
STOP[list(b".!?")] = True

LOW = np.int64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread, one to one (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (starts.astype(np.int64) << np.int64(32)) | ends.astype(np.int64)


def blanks_of(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are of blanks, those beyond ASCII included."""
    blank = BLANK[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        more = np.r_[data, np.zeros(2, dtype=np.uint8)]
        one, two, three = (more[lead + i].astype(np.int32) for i in range(3))
        short = lead[(one == 0xC2) & ((two == 0x85) | (two == 0xA0))]
        code = (one & 15) << 12 | (two & 63) << 6 | three & 63
        wide = (code == 0x1680) | ((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
        long = lead[(one > 0xC2) & wide]
        for at in (short, short + 1, long, long + 1, long + 2):
            blank[at] = True
    return blank


class Sums:
    """Hashes of runs of values by rolling sums; the powers are kept and grow with the longest sequence."""

    def __init__(self, base: int):
        self.base = base
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def over(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if n + 1 > len(self.powers):
            size = max(n + 1, 2 * len(self.powers))
            inverse = pow(self.base, -1, 1 << 64)
            self.powers, self.inverse = (
                np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)], dtype=np.uint64)
                for b in (self.base, inverse))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[:n], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the runs from each start to before each end."""
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])


class Hashing:
    """What hashes words by their bytes and runs by their words."""

    def __init__(self):
        self.codes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.bytes, self.words = Sums(0xD6E8FEB86659FD93), Sums(0xC2B2AE3D27D4EB4F)


class Words:
    """Words of the texts of one chunk. `first[d]` is the place of text d's first word, `first[d + 1]` that after its last."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, hashing: Hashing):
        self.data, self.bounds, self.hashing = data, bounds, hashing
        blank = blanks_of(data)
        # The last byte of a text and the first of the next are parted like words.
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        before = np.r_[True, blank]
        after = np.r_[blank, True]
        self.starts = np.flatnonzero(~blank & (before[:-1] | edge[:-1]))
        self.ends = np.flatnonzero(~blank & (after[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def sums(self) -> np.ndarray:
        """Rolling sums over the hashes of words."""
        h = self.hashing
        return h.words.over(h.bytes.runs(h.bytes.over(h.codes[self.data]), self.starts, self.ends))

    def until(self, places: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where the words before the given places end, with the blanks after them."""
        last = places >= self.first[texts + 1]
        at = self.starts[np.minimum(places, len(self.starts) - 1)] if len(self.starts) else places
        return np.where(last, self.bounds[texts + 1], at) - self.bounds[texts]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, place after the last, text, and span of each line with words."""
        n = len(self.starts)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none
        feeds = np.r_[0, np.cumsum(self.data == 10)]
        parted = STOP[self.data[self.ends - 1]]
        parted[:-1] |= feeds[self.starts[1:]] > feeds[self.ends[:-1]]
        parted[self.first[1:][np.diff(self.first) > 0] - 1] = True
        after = np.flatnonzero(parted) + 1
        first = np.r_[0, after[:-1]]
        text = self.text[first]
        start = self.starts[first] - self.bounds[text]
        # Blanks before a text's first line are of it, unless a line feed is among them.
        begins = first == self.first[text]
        start[begins & (feeds[self.starts[first]] == feeds[self.bounds[text]])] = 0
        return first, after, text, packed(start, self.until(after, text))


def chunks_of(texts: pa.Array, hashing: Hashing) -> Iterator[tuple[int, int, Words]]:
    """Chunks of a column of texts: first row, row after the last, words."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
        yield row, end, Words(raw[ends[row]:ends[end]], ends[row:end + 1] - ends[row], hashing)
        row = end


def lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType | None = None) -> pa.Array:
    """A column of arrays: the values of each row; owners rise."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def line_arrays(words: Words, line_words: int, block_words: int) -> dict[str, pa.Array]:
    """Lines with enough words, and the shortest runs of lines that reach `block_words`, from each line on and from each back."""
    first, after, text, spans = words.lines()
    long = after - first >= line_words
    first, after, text, spans = first[long], after[long], text[long], spans[long]
    rows, n = len(words.bounds) - 1, len(first)
    raw = words.data.tobytes()
    hashes = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(
        words.starts[first].tolist(), words.ends[after - 1].tolist(), strict=True)], dtype=np.uint64)
    total = np.r_[0, np.cumsum(after - first)]
    begin = np.searchsorted(text, np.arange(rows + 1))
    on = np.searchsorted(total, total[:-1] + block_words)
    back = np.searchsorted(total, total[1:] - block_words, "right") - 1
    places = np.arange(n)
    ahead, behind = on <= begin[text + 1], (back >= begin[text]) & (total[1:] >= block_words)
    start = np.r_[places[ahead], back[behind]]
    end = np.r_[on[ahead], places[behind] + 1]
    both = np.unique(start * (n + 1) + end)
    start, end = both // (n + 1), both % (n + 1)
    owner, base = text[start], begin[text[start]]
    h = words.hashing.words
    return {
        "lines": lists(hashes, text, rows), "words": lists((after - first).astype(np.int32), text, rows),
        "spans": lists(spans, text, rows), "starts": lists((start - base).astype(np.int32), owner, rows),
        "ends": lists((end - base).astype(np.int32), owner, rows),
        "windows": lists(h.runs(h.over(mixed(hashes)), start, end), owner, rows)}


def least_of(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours."""
    width = 1
    while width < wide:
        step = min(width, wide - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def group_arrays(words: Words, window: int, least: int) -> dict[str, pa.Array]:
    """Groups of neighbouring windows of words with one mark: mark, hash of all the group's words, span.

    A window's mark is the least hash of the runs of a third of its words in it.
    A text of fewer words than a window, but `least` at least, is one group.
    """
    sums, h = words.sums(), words.hashing.words
    n, rows, part = len(words.starts), len(words.bounds) - 1, window // 3
    size = np.diff(words.first)
    whole = np.flatnonzero((size >= least) & (size < window))
    whole_hash = h.runs(sums, words.first[whole], words.first[whole + 1])
    start = end = owner = np.zeros(0, dtype=np.int64)
    mark = np.zeros(0, dtype=np.uint64)
    if n >= window:
        at = np.arange(n - part + 1)
        marks = least_of(h.runs(sums, at, at + part), window - part + 1)
        at = np.flatnonzero(np.arange(len(marks)) + window <= words.first[words.text[:len(marks)] + 1])
        marks, texts = marks[at], words.text[at]
        new = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]) | (texts[1:] != texts[:-1])][:len(at)])
        last = np.r_[new[1:], len(at)] - 1
        start, end, owner, mark = at[new], at[last] + window, texts[new], marks[new]
    group = np.r_[h.runs(sums, start, end), whole_hash]
    mark = np.r_[mark, mixed(whole_hash ^ np.uint64(window))]
    start, end, owner = np.r_[start, words.first[whole]], np.r_[end, words.first[whole + 1]], np.r_[owner, whole]
    spans = packed(words.starts[start] - words.bounds[owner], words.until(end, owner)) if len(start) else start
    order = np.argsort(owner, kind="stable")
    return {"marks": lists(mark[order], owner[order], rows), "groups": lists(group[order], owner[order], rows),
            "group_spans": lists(spans[order], owner[order], rows)}


def windows_in(words: Words, groups: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and span of all windows in the given spans of each text; neighbours that are equal are one."""
    sums, h = words.sums(), words.hashing.words
    owner = np.repeat(np.arange(len(groups)), [len(x) for x in groups])
    spans = np.concatenate([*groups, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    base = words.bounds[owner]
    start = np.searchsorted(words.starts, base + (spans >> np.int64(32)))
    end = np.searchsorted(words.starts, base + (spans & LOW))
    count = np.maximum(end - start - window + 1, 0)
    at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]][:len(count)], count) + np.arange(count.sum())
    owner = np.repeat(owner, count)
    order = np.lexsort((at, owner))
    at, owner = at[order], owner[order]
    hashes = h.runs(sums, at, at + window)
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + 1)][:len(at)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)][:len(first)] - 1 if len(first) else first
    owner = owner[first]
    begun = words.starts[at[first]] - words.bounds[owner] if len(first) else first
    return owner, hashes[first].view(np.int64), packed(begun, words.until(at[last] + window, owner))


def without(text: bytes, spans: np.ndarray) -> bytes:
    """The text without spans, which may overlap."""
    spans = np.sort(spans)
    start, end = spans >> np.int64(32), np.maximum.accumulate(spans & LOW)
    kept_from, kept_to = np.r_[0, end], np.r_[start, len(text)]
    some = kept_to > kept_from
    return b"".join([text[a:b] for a, b in zip(kept_from[some].tolist(), kept_to[some].tolist(), strict=True)])
