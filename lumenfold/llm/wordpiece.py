"""Token ids of a tokenizers vocabulary, with a bounded cache of words.

The vocabulary drops white space and never merges across it, so a text's ids are its words' ids in a row.  A word
that was seen before costs one dictionary lookup.  A new word made of Latin-1 characters is cut by the vocabulary's
own pattern and its parts go straight to the library's BPE model; any other word takes the library's whole path.
"""

from __future__ import annotations

import struct

import regex
from tokenizers import Tokenizer

_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes printable bytes as themselves and the rest as the code points from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(moved)}


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Words in two generations of at most ``bound`` each, so that frequent ones outlive a flood of rare ones."""

    def __init__(self, encode, bound: int):
        super().__init__()
        self.encode, self.bound, self.old = encode, bound, {}

    def known(self, word: str) -> bytes | None:
        return self.get(word) or self.old.get(word)

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class WordEncoder:
    """``bytes_of(text)`` gives the ids as little-endian unsigned 32-bit integers.  ``bound``: words in a generation of the cache."""

    def __init__(self, path: str, bound: int = 250_000):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.words = _Words(self._word, bound)
        self.exact = _Words(self._whole, bound // 10)

    def _whole(self, word: str) -> bytes:
        return _little(self.library.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # those bytes are written as themselves
        if plain and not word[-1].isalpha() and (known := self.words.known(word[:-1])) and word[:-1].isalpha():
            return known + self.words[word[-1]]  # the pattern cuts a stop from its word
        parts = (word,) if word.isalpha() else _PARTS.findall(word)
        if not plain:
            parts = [p.encode().decode("latin-1").translate(self.alphabet) for p in parts]
        tokenize = self.model.tokenize
        return _little([t.id for p in parts for t in tokenize(p)])

    def bytes_of(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text) if self._odd(text) else b"".join(map(self.exact.__getitem__, text.split()))
        low = text.lower()
        if self._odd(text) or any(s in low for s in self.special):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, low.split()))

    @staticmethod
    def _odd(text: str) -> bool:
        """Four controls that only Python counts as white space."""
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
