"""Byte-level BPE by pieces: each distinct piece of text is encoded once.

A byte-level model merges within the matches of a pattern only, so a piece has
the same tokens wherever it stands. The pieces of a text are found with the
pattern, the distinct ones, each byte as one printable character, go to the BPE model of
the ``tokenizers`` library, and the tokens of a text are those of its pieces.
Tokens stand for bytes, one after the other, so their offsets are sums of
lengths, brought back from bytes to characters.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

LONG_PIECE = 256
"""Pieces of more characters are not remembered."""

MOST_PIECES = 300_000
"""So many pieces are remembered by a worker before it starts afresh."""


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _byte_table() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


def to_byte_characters(text: str) -> str:
    """The UTF-8 bytes of a text, each as its character."""
    return text.encode().decode("latin-1").translate(_byte_table())


@lru_cache(maxsize=1)
def _newer_characters() -> list[tuple[str, str]]:
    """Ranges of letters and digits that the ``tokenizers`` library does not know as such.

    Its Unicode tables are older than those of ``regex``; texts with these
    characters are cut by the library itself.
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    everything = "".join(map(chr, chain(range(1, 0xD800), range(0xE000, 0x110000))))
    newer: set[int] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        mine = "".join(regex.findall(kind, everything))
        rest = pre_tokenizers.Split(Regex(kind), behavior="removed").pre_tokenize_str(mine)
        newer |= {ord(c) for piece, _ in rest for c in piece}
    first = sorted(c for c in newer if c - 1 not in newer)
    last = sorted(c for c in newer if c + 1 not in newer)
    return [(chr(a), chr(b)) for a, b in zip(first, last, strict=True)]


class PieceEncoder:
    """Encodes texts with a byte-level model of the ``tokenizers`` library.

    ``vocabulary`` has the model's tokens, written in byte characters; ``special``
    maps strings that stand for one token, wherever they occur, to their ids.
    The pattern has to match every character.
    """

    def __init__(
        self,
        model,
        vocabulary: dict[str, int],
        pattern: str,
        special: dict[str, int] | None = None,
        most: int = MOST_PIECES,
    ):
        import regex
        from tokenizers import Regex, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = model
        self.most = most
        self.vocabulary = vocabulary
        self.special = special or {}
        self.lengths = np.zeros(max([*vocabulary.values(), *self.special.values()]) + 1, np.int64)
        for token, own in vocabulary.items():
            self.lengths[own] = len(token)
        for token, own in self.special.items():
            self.lengths[own] = len(token.encode())
        own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(own)
        self.library = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
        self.first_newer = min(ord(a) for a, _ in _newer_characters())
        self.newer = re.compile("[" + "".join(map("-".join, _newer_characters())) + "]")
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known: dict[str, bytes] = {}

    def _may_be_newer(self, text: str) -> bool:
        """A quick test, to leave out the slow one in most texts."""
        if text.isascii():
            return False
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return bool((points >= self.first_newer).any())

    def _matches(self, text: str) -> list[str]:
        if self._may_be_newer(text) and self.newer.search(text):
            found = [piece for piece, _ in self.library.pre_tokenize_str(text)]
        else:
            found = self.pieces.findall(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern does not match every character")
        return found

    def _split(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return self._matches(text)
        parts = self.split.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._matches(part))]

    def _tokens(self, piece: str) -> bytes:
        if piece in self.special:
            ids = [self.special[piece]]
        else:
            ids = [t.id for t in self.model.tokenize(to_byte_characters(piece))]
        return np.array(ids, "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text's tokens as little-endian unsigned 32-bit integers."""
        pieces = self._split(text)
        known = self.known
        missing = set(pieces).difference(known)
        if missing:
            new = {piece: self._tokens(piece) for piece in missing}
            if any(len(piece) > LONG_PIECE for piece in new):
                return b"".join([known.get(p) or new[p] for p in pieces])
            if len(known) + len(new) > self.most:
                new |= {piece: known[piece] for piece in set(pieces).intersection(known)}
                known.clear()
            known |= new
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's tokens and the characters where they start.

        A token that starts within a character starts where the character does.
        """
        ids = np.frombuffer(self.packed(text), "<u4")
        return ids, self.starts(text, ids)

    def starts(self, text: str, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        at = np.cumsum(sizes) - sizes
        if text.isascii() or not len(ids):
            return at
        data = np.frombuffer(text.encode(), np.uint8)
        return np.cumsum((data & 0xC0) != 0x80)[at] - 1
