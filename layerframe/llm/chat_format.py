"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered as a whole, a turn as ``[INST]role[/INST]text</s>``.
Control strings inside roles and texts get a backslash after their first
character, or one more if they have some, so that they can't be taken for the
template's and the original can be read back. The rendered text is encoded once;
the template's control strings are tokens of their own. Turn spans and token
spans are both sorted, so the tokens of a turn are found by binary search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_array, text_or_empty
from .pieces import PieceEncoder
from .token_counts import PATTERN, encoder_of_json

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"

_ESCAPE = re.compile(r"(\[|<)(?=\\*(?:/?INST\]|/s>))")
_UNESCAPE = re.compile(r"(\[|<)\\(?=\\*(?:/?INST\]|/s>))")

FORMATTED = (
    "formatted string, token_ids array<int>, token_starts array<int>, "
    "loss_first array<int>, loss_last array<int>, span_starts array<int>, span_ends array<int>"
)


def escape(text: str) -> str:
    """Put a backslash into each control string, escaped ones included."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of the turns of one role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def token_spans(starts: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last (exclusive) token of each span of characters.

    Spans begin and end where control strings do, so they hold whole tokens.
    Both sides are sorted: two binary searches a span.
    """
    begins = np.array([a for a, _ in spans], np.int64)
    ends = np.array([b for _, b in spans], np.int64)
    first = np.searchsorted(starts, begins, "left")
    last = np.searchsorted(starts, ends, "left")
    return list(zip(first.tolist(), last.tolist(), strict=True))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a rendered conversation."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(CLOSE)
        turns.append((unescape(role), unescape(text)))
    return turns


@lru_cache(maxsize=2)
def _cached_encoder(path: str) -> PieceEncoder:
    plain = encoder_of_json(path)
    first = max(plain.special.values(), default=0) + 1
    special = {name: first + i for i, name in enumerate((OPEN, CLOSE, END))}
    return PieceEncoder(plain.model, plain.vocabulary, PATTERN, special)


def format_conversations(rows: DataFrame, path: str, learned: str = "assistant") -> DataFrame:
    """A row per conversation: rendered text, tokens and loss spans.

    ``rows`` has conv_id, turn, role and text; other columns are left out. Turns
    are ordered by turn (null first), then role and text, so ties and repeated
    rows have a fixed order; null roles and texts are empty; a null conv_id is
    one conversation. Tokens ``loss_first[i]`` to ``loss_last[i]`` (exclusive)
    make up characters ``span_starts[i]`` to ``span_ends[i]``, the i-th turn of
    the learned role. A conversation has to fit into one row, as its
    rendered text does.
    """
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
            )
        ).alias("turns")
    )

    @F.arrow_udf(f"struct<{FORMATTED.replace(' string', ':string').replace(' array', ':array')}>")
    def formatted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _cached_encoder(path)
        for conversations in batches:
            columns: list[list] = [[] for _ in range(7)]
            for conversation in conversations:
                own = [(t["role"], t["text"]) for t in conversation.as_py()]
                text, spans = render(own, learned)
                ids, starts = encoder.encode(text)
                tokens = token_spans(starts, spans)
                for column, value in zip(
                    columns,
                    (text, ids, starts, *zip(*tokens, strict=True), *zip(*spans, strict=True))
                    if spans
                    else (text, ids, starts, [], [], [], []),
                    strict=True,
                ):
                    column.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(columns[0], pa.string())]
                + [list_array(c, pa.int32()) for c in columns[1:]],
                [f.split(" ")[0] for f in FORMATTED.split(", ")],
            )

    return turns.select("conv_id", formatted("turns").alias("formatted")).select("conv_id", "formatted.*")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\[|<)\\(?=\\*(?:/?INST\]|/s>))", "$1")


def formatted_turns(formatted: Column) -> Column:
    """Roles and texts of a rendered conversation, read back from it."""
    turns = F.split(formatted, END)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(text: Column) -> Column:
        inner = F.substring(text, len(OPEN) + 1, F.length(text))
        at = F.locate(CLOSE, inner)
        return F.struct(
            _unescaped(F.substring(inner, F.lit(1), at - 1)).alias("role"),
            _unescaped(F.substring(inner, at + len(CLOSE), F.length(inner))).alias("text"),
        )

    return F.transform(turns, turn)


def masked_text(df_columns: dict[str, Column]) -> Column:
    """All text under the loss mask, unescaped, put together from token offsets.

    A token ends where the next one starts; the last ends with the text.
    """
    starts, formatted = df_columns["token_starts"], df_columns["formatted"]
    all_starts = F.concat(starts, F.array(F.length(formatted)))
    spans = F.arrays_zip(df_columns["loss_first"].alias("a"), df_columns["loss_last"].alias("b"))

    def span(own: Column, s: Column) -> Column:
        begin = F.element_at(own, s["a"] + 1)
        end = F.element_at(own, s["b"] + 1)
        return _unescaped(F.substring(formatted, begin + 1, end - begin))

    # In an array of one, so that the starts are put together once, not for each span.
    whole = F.transform(
        F.array(all_starts), lambda own: F.array_join(F.transform(spans, lambda s: span(own, s)), "")
    )
    return F.element_at(whole, 1)
