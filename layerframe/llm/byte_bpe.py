"""Byte-level BPE encoding and decoding.

The ranks of a tiktoken file become a model of the ``tokenizers`` library:
each byte is written as one printable character, each match of the pattern is
merged by itself, and every way of putting a token together is a merge with the
rank of the result, as merging by ranks asks. Decoding goes back through the
byte table; a character split over tokens is whole again once their bytes are
joined.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .pieces import MOST_PIECES, PieceEncoder, byte_characters

def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder_of_ranks(ranks: dict[bytes, int], pattern: str, most: int = MOST_PIECES) -> PieceEncoder:
    """An encoder of the ``tokenizers`` library's BPE model that merges by ranks."""
    from tokenizers import models

    letters = byte_characters()
    shown = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    vocabulary = {shown[token]: rank for token, rank in ranks.items()}
    model = models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True)
    return PieceEncoder(model, vocabulary, pattern, most=most)


@lru_cache(maxsize=4)
def _cached_encoder(path: str, pattern: str, most: int) -> PieceEncoder:
    return encoder_of_ranks(read_ranks(path), pattern, most)


@lru_cache(maxsize=4)
def _cached_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, with each id's start and length."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    offsets: bool = True,
    decoded: bool = False,
    most_pieces: int = MOST_PIECES,
) -> DataFrame:
    """``docs`` with the tokens of its whole texts.

    Added are ``token_ids`` (little-endian unsigned 32-bit integers, the form of
    token files; ``unpacked`` makes an array of them), with ``offsets``
    ``token_starts`` (the same form: the character where each token starts; tokens
    that share a character start at the same one), and with ``decoded`` the
    ``decoded`` bytes of the ids. Columns of these names are replaced. Null texts
    count as empty and have no tokens; strings that look like special tokens are
    ordinary text. ``path`` names a rank file that every executor can open. Rows
    are handed on in batches of bounded size, so memory does not grow with the
    table; a row needs some times its text. A worker remembers the tokens of
    ``most_pieces`` pieces, which costs it some 250 bytes each.
    """
    added = ["token_ids"] + ["token_starts"] * offsets + ["decoded"] * decoded
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    schema = T.StructType(kept.schema.fields + [T.StructField(c, T.BinaryType(), False) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _cached_encoder(path, pattern, most_pieces), _cached_bytes(path)
        for batch in batches:
            texts = batch.column("text")
            for first, part in slices(texts):
                columns: list[list[bytes]] = [[] for _ in added]
                for text in part:
                    packed = encoder.packed(text)
                    ids = np.frombuffer(packed, "<u4")
                    made = [packed]
                    if offsets:
                        made.append(encoder.starts(text, ids).astype("<u4").tobytes())
                    if decoded:
                        made.append(token_bytes(ids, table))
                    for column, value in zip(columns, made, strict=True):
                        column.append(value)
                own = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *(pa.array(c, pa.binary()) for c in columns)],
                    [*batch.schema.names, *added],
                )

    return kept.mapInArrow(run, schema)


def unpacked(ids: Column | str) -> Column:
    """An array of the numbers that little-endian 32-bit bytes hold."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    n = (F.octet_length(ids) / 4).cast("int")

    def number(i: Column) -> Column:
        digits = F.hex(F.substring(ids, i * 4 + 1, F.lit(4)))
        turned = F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])
        return F.conv(turned, 16, 10).cast("long")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(
        F.array().cast("array<bigint>")
    )


def token_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The bytes of a row of tokens, one after the other."""
    data, first, lengths = table
    ids = ids.astype(np.int64)
    sizes = lengths[ids]
    begins = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(first[ids] - begins, sizes)].tobytes()


def decode(ids: Column | str, path: str) -> Column:
    """The bytes that packed token ids stand for; null gives no bytes.

    Bytes, because a cut row of ids may begin or end within a character:
    ``decode_text`` makes text of them.
    """

    @F.arrow_udf(T.BinaryType())
    def decoded(packed: pa.Array) -> pa.Array:
        table = _cached_bytes(path)
        whole = [token_bytes(np.frombuffer(p.as_py() or b"", "<u4"), table) for p in packed]
        return pa.array(whole, pa.binary())

    return decoded(ids)


def decode_text(data: Column) -> Column:
    """Text of decoded bytes; what is no character becomes U+FFFD."""
    return F.decode(data, "UTF-8")
