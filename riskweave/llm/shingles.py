"""Word shingles of whole texts as hashes, with numpy over many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed together.
CHUNK = 1 << 20

# Words are separated by these bytes: space, and 09 to 0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def letters() -> np.ndarray:
    """A value for each byte; capital A to Z have those of small letters."""
    values = mix(np.arange(1, 257, dtype=np.uint64))
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Shingler:
    """Hashes of the distinct shingles of texts: `words` words each, or all words of a shorter text."""

    def __init__(self, words: int):
        self.words = words
        self.letters = letters()
        self.space = np.zeros(256, dtype=bool)
        self.space[list(SEPARATORS)] = True
        self.weights = mix(np.arange(1000, 1000 + words, dtype=np.uint64)) | _U(1)
        self.up, self.down = powers(CHUNK + 2)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        chunk: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            if chunk and size + len(raw) > CHUNK:
                out += self._chunk(chunk)
                chunk, size = [], 0
            chunk.append(raw)
            size += len(raw) + 1
        return out + (self._chunk(chunk) if chunk else [])

    def _chunk(self, raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = powers(len(data) + len(data) // 2)
        blank = self.space[data]
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        # A word's hash is its polynomial in the base, moved to the text's start.
        sums = np.cumsum(self.letters[data] * self.up[: len(data)])
        hashes = mix((sums[ends - 1] - sums[starts - 1]) * self.down[starts] + (ends - starts).astype(np.uint64))
        edges = np.cumsum([1] + [len(r) + 1 for r in raw])
        first = np.searchsorted(starts, edges[:-1])
        last = np.searchsorted(starts, edges[1:])
        k = self.words
        n = len(hashes)
        if n >= k:
            rolled = np.zeros(n - k + 1, dtype=np.uint64)
            for j in range(k):
                rolled += hashes[j:n - k + 1 + j] * self.weights[j]
            rolled = mix(rolled)
        found = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= k:
                values = np.sort(rolled[a:b - k + 1])
                found.append(values[np.r_[True, values[1:] != values[:-1]]])
            elif b > a:
                whole = (hashes[a:b] * self.weights[: b - a]).sum(dtype=np.uint64) + _U(b - a)
                found.append(mix(np.array([whole], dtype=np.uint64)))
            else:
                found.append(np.zeros(0, dtype=np.uint64))
        return found
