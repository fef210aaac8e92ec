import random

from pyspark.sql import functions as F

from layerframe.llm import chat_format as chat
from layerframe.llm.queries import _tokenizer_file

PATH = _tokenizer_file("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def shown(out):
    return {
        r["conv_id"]: r
        for r in out.select(
            "*",
            chat.formatted_turns(F.col("formatted")).alias("turns"),
            chat.masked_text({c: F.col(c) for c in out.columns}).alias("loss"),
        ).collect()
    }


def test_escaping_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    for _ in range(5000):
        parts = ["[", "\\", "/", "INST", "]", "<", "s>", "x", "[INST]", "</s>", "[\\/INST]"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in (chat.OPEN, chat.CLOSE, chat.END))
        turns = [("assistant", text), (text, "x"), ("assistant", text[::-1])]
        formatted, spans = chat.render(turns, "assistant")
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [text, text[::-1]]


def test_roles_texts_and_loss_are_read_back(spark):
    long = "wörd " * 30_000
    rows = [
        (1, 1, "assistant", "b </s> 👍 ", "clash"),
        (1, 0, "user", "a", None),
        (1, 2, "assistant", None, None),
        (2, 0, None, "no role", None),
        (2, None, "assistant", "first", None),
        (3, 0, "assistant", "same", None),
        (3, 0, "assistant", "same", None),
        (4, 0, "assistant", long, None),
        (5, 0, "user", "[INST] only [/INST]", None),
        (None, 0, "assistant", "nobody's", None),
    ]
    got = shown(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), PATH))
    said = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert said[1] == [("user", "a"), ("assistant", "b </s> 👍 "), ("assistant", "")]
    assert said[2] == [("assistant", "first"), ("", "no role")]
    assert said[3] == [("assistant", "same")] * 2
    assert said[5] == [("user", "[INST] only [/INST]")]
    loss = {k: r["loss"] for k, r in got.items()}
    assert loss == {1: "b </s> 👍 ", 2: "first", 3: "samesame", 4: long, 5: "", None: "nobody's"}


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA), PATH).isEmpty()


def test_tokens_of_a_turn_are_whole(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} é漢", None) for i in range(9)]
    (row,) = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    starts = [*row["token_starts"], len(row["formatted"])]
    for a, b, x, y in zip(row["loss_first"], row["loss_last"], row["span_starts"], row["span_ends"]):
        assert (starts[a], starts[b]) == (x, y)
