"""Whole texts to token ids with a public tokenizer, word by word.

The tokenizer's own model does the work. Text is cut into the pieces its
pre-tokenizer would make, and a piece's ids are remembered, so that the model
sees each piece once per worker and not once per occurrence. Texts with
letters outside the Latin blocks, other kinds of white space or special tokens
are given to the tokenizer whole; in the rest, lower case is all that
normalizing changes.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

from tokenizers import Tokenizer

from riskweave.llm.common import kept

# The classes of characters up to U+024F that the pre-tokenizers tell apart.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
SPACE = " \t\n\r\f\v"
#: Anything else is left to the tokenizer.
UNUSUAL = re.compile(r"[^\t-\r -~¡-įıĲ-ɏ–—‘-”…]|<\|")
#: Texts without UNUSUAL, but for special tokens; one run of a class is matched quicker than searched for.
USUAL = re.compile(r"[\t-\r -~¡-įıĲ-ɏ–—‘-”…]*")

# How the two kinds of vocabulary file cut text into pieces.
BYTE_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")

#: Pieces a worker remembers from lately, and as many again from before.
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def as_bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class PieceIds(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers, made when first asked for."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, byte_letters()
        self.blank = self.letters[ord(" ")]
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        found = self.before.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                letters = piece.replace(" ", self.blank)
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            found = as_bytes([t.id for t in self.model.tokenize(letters)])
        self[piece] = found
        return found


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.words = json.load(file)["normalizer"] is not None
        self.pieces = WORD_PIECES if self.words else BYTE_PIECES
        self.ids = PieceIds(self.tokenizer)

    def encode(self, text: str) -> bytes:
        """Ids of a text, without special tokens added, as little-endian unsigned 32-bit integers."""
        if "<|" in text or not USUAL.fullmatch(text):
            return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.words:
            text = text.lower()
        return b"".join(map(self.ids.__getitem__, self.pieces.findall(text)))


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker."""
    return kept(("encoder", path), lambda: Encoder(path))
