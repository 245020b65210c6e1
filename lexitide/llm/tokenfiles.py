"""Tokenizer files and fast whole-text encoding inside tasks, by piece rather than by text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# The split rule of byte-level BPE vocabularies, for texts whose characters are all in `_PLAIN`.
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ODD = re.compile("[^\u0000-ɏ‐-‧‰-⁞€]")
KEPT = 500_000  # pieces in each of the two generations that a worker remembers


def tokenizer(path: str, special: bool = True):
    """The tokenizer of a file, without truncation or padding, once per worker; without `special`, special tokens' strings are plain text."""
    return _tokenizer(path, special)


@lru_cache(maxsize=4)
def _tokenizer(path: str, special: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = not special
    return t


def encode_words(path: str, words: list[str]) -> list[list[int]]:
    encode = tokenizer(path).encode
    return [encode(w, add_special_tokens=False).ids for w in words]


class _Pieces(dict):
    """Ids of pieces as bytes, found with the tokenizer when first asked for; seldom used ones are forgotten."""

    def __init__(self, path: str, code: str, special: bool, kept: int | None):
        self.encode, self.code, self.older, self.kept = tokenizer(path, special).encode, code, {}, kept or KEPT

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array(self.code, self.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


@lru_cache(maxsize=4)
def piece_encoder(path: str, width: int, special: bool = True, kept: int | None = None) -> Callable[[str], bytes]:
    """Encode a text as the byte-level tokenizer of `path` does, to native ids of `width` bytes; calls it per new piece.

    Such tokenizers merge within pieces only. A text that holds an added token or a character outside the plain ranges
    goes to the tokenizer whole, so its split never depends on this module's rule.
    """
    added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values() if special or not t.special]
    code = next(c for c in "HIL" if array(c).itemsize == width)
    pieces = _Pieces(path, code, special, kept)

    def encode(text: str) -> bytes:
        if _ODD.search(text) or any(a in text for a in added):
            return array(code, tokenizer(path, special).encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(pieces.__getitem__, _PIECE.findall(text)))

    return encode


def gather(values: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenation of `values[start[r]:start[r + 1]]` over `rows`."""
    lo, size = start[rows], start[rows + 1] - start[rows]
    before = np.cumsum(size) - size
    return values[np.repeat(lo - before, size) + np.arange(int(size.sum()))]
