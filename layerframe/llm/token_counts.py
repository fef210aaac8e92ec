"""Token counts of whole documents, huge ones by overlapping chunks.

A huge text is encoded in chunks that overlap, so no call of the library takes
more than one chunk. Two neighbours are joined at a place in their overlap
where both have a token boundary that is proven to hold in any context: a
character that is not white space, then one that is. No match of the pattern
of the byte-level models contains that pair, no special token contains white
space, and what stands before the pair is matched alike whatever follows the
white space. Where an overlap has no such place, it is widened, up to the rest
of the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_or_empty
from .pieces import PieceEncoder

CHUNK = 32_768
OVERLAP = 512

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed value: what the byte-level pre-tokenizer of the library matches."""

_STABLE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")


def encoder_of_json(path: str) -> PieceEncoder:
    """An encoder for a byte-level BPE file of the ``tokenizers`` library.

    The file's added tokens are found inside texts, as the library does.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"] or {}
    if before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        raise ValueError("only byte-level files are supported")
    if before.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("files that change texts before splitting are not supported")
    added = spec["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] or
           regex.search(r"\p{White_Space}", t["content"]) for t in added):
        raise ValueError("added tokens that take in or hold white space are not supported")
    special = {t["content"]: t["id"] for t in added}
    tokenizer = Tokenizer.from_file(path)
    return PieceEncoder(
        tokenizer.model, tokenizer.get_vocab(with_added_tokens=False), PATTERN, special
    )


@lru_cache(maxsize=2)
def _cached_encoder(path: str) -> PieceEncoder:
    return encoder_of_json(path)


def _common_boundary(text: str, low: int, high: int, left: np.ndarray, right: np.ndarray) -> int | None:
    """The first proven boundary in [low, high) that is a token start on both sides."""
    stable = np.array([m.start() for m in _STABLE.finditer(text, low, high)], np.int64)
    both = np.intersect1d(np.intersect1d(stable, left), right)
    return int(both[0]) if len(both) else None


def count_in_chunks(encoder: PieceEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, of which at most about a chunk is encoded at a time."""
    total, begin = 0, 0
    while True:
        wide = overlap
        while True:
            end = begin + chunk + wide
            if end >= len(text):
                return total + len(encoder.packed(text[begin:])) // 4
            left = encoder.encode(text[begin:end])[1] + begin
            next_begin = begin + chunk
            right = encoder.encode(text[next_begin : next_begin + chunk + wide])[1] + next_begin
            cut = _common_boundary(text, next_begin + 1, end, left, right)
            if cut is not None:
                break
            wide *= 2
        total += int(np.searchsorted(left, cut, "left"))
        begin = cut


def count_tokens(
    text: Column | str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> Column:
    """Number of tokens of a whole text; null counts as empty and has none.

    ``path`` names a byte-level file of the ``tokenizers`` library that every
    executor can open. Nothing is added or cut off; special tokens written out
    in a text count as one token.
    """
    if chunk < 1 or overlap < 1:
        raise ValueError("chunk and overlap have to be positive")

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _cached_encoder(path)
        for texts in batches:
            counts = [
                len(encoder.packed(text)) // 4
                if len(text) <= chunk + overlap
                else count_in_chunks(encoder, text, chunk, overlap)
                for text in (t.as_py() for t in texts)
            ]
            yield pa.array(counts, pa.int64())

    return counted(text_or_empty(text))
