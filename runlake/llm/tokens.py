"""Exact, cached tokenisation with the public tokenizer files.

Most of a text is words that were seen before, so ids are looked up per white-space piece and only
unseen pieces reach the ``tokenizers`` library. Pieces are cut where the library's own pre-tokenizer
always cuts too, so the ids equal those of encoding the whole text:

* byte-level BPE: before a single space between two non-spaces, and before a single newline between
  two non-spaces. A text with any other white space at a piece's edge is encoded whole.
* word BPE: at every space and newline (white space is dropped by its pre-tokenizer).

Caches are bounded by ``CACHE_ENTRIES`` and start afresh when full.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np

CACHE_ENTRIES = 400_000
LATIN_END = "\u0250"
_LOADED: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per file and process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def resolve(path_or_name: str) -> str:
    """A tokenizer file's place: a path as it is, a bare name through the public package."""
    if os.sep in path_or_name:
        return path_or_name
    import public_tokenizers

    return public_tokenizers.path(path_or_name)


def _byte_letters() -> list[str]:
    """The letters by which byte-level BPE writes the 256 bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Stray(Exception):
    """A piece that can't be encoded on its own."""


class Encoder(dict):
    """``encode(text)``: ids as little-endian uint32 bytes, as the library gives them without added special tokens.

    As a dict it holds the ids of the pieces seen so far. A piece follows a space, unless it begins
    with the newline that it follows.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolve(path))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        self.space = "" if self.words else self.letters[32]
        self.bpe = self.tokenizer.model.tokenize
        #: Letters, then marks that are neither letters, digits nor white space: two pre-tokens.
        self.lettered = re.compile(r"([^\W\d_]+)([^\w\s]+)\Z").match
        self.marks: dict[str, bytes] = {}
        self.newline = b"" if self.words else self._whole("\n")
        if self.words:
            self[""] = b""

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _stem(self, word: str, space: str) -> bytes:
        """One pre-token of letters, straight to the BPE model."""
        written = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array.array("I", [t.id for t in self.bpe(space + written)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            ids = self.marks[mark] = self._whole(mark)
        return ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            if self.words:
                self[""] = b""
        #: Latin letters have no marks apart, so they are normalised, and lower-casing is letter by letter (but for the dotted capital I).
        plain = not self.words or piece and max(piece) < LATIN_END and "\u0130" not in piece
        if plain and piece.isalpha():
            ids = self[piece] = self._stem(piece.lower() if self.words else piece, self.space)
            return ids
        if plain and (m := self.lettered(piece)) and m[1].isalpha():
            seen = m[1] in self
            ids = self[m[1]] + self._mark(m[2])
            if seen:
                self[piece] = ids
            return ids
        if not self.words:
            if piece[:1] == "\n" and (bare := piece[1:].rstrip(".,")).isalpha():
                ids = self.newline + self._stem(bare, "") + (self._mark(piece[1 + len(bare) :]) if len(bare) < len(piece) - 1 else b"")
                self[piece] = ids
                return ids
            bare = piece[1:] if piece[:1] == "\n" else piece
            if not bare or bare[0].isspace() or bare[-1].isspace():
                raise _Stray
        ids = self[piece] = self._whole(piece if self.words or piece[0] == "\n" else " " + piece)
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        parts = text.replace("\n", " \n").split(" ")
        first = parts[0]  # no space before it
        if not first or first[0].isspace() or first[-1].isspace():
            return self._whole(text)
        parts[0] = "\n" + first
        try:
            return b"".join(map(self.__getitem__, parts))[len(self.newline) :]
        except _Stray:
            return self._whole(text)


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")
