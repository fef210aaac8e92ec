import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from layerframe.llm import byte_bpe
from layerframe.llm.queries import _tokenizer_file, op3_byte_bpe, op5_token_counts
from layerframe.llm.token_counts import count_in_chunks, count_tokens, encoder_of_json

RANKS = _tokenizer_file("byte_bpe_multi_50k.tiktoken")
JSON = _tokenizer_file("byte_bpe_50k.json")
EDGES = [
    None, "", " ", "\n\n  x", "a" * 70_000, "word " * 40_000, "é漢👍🏽 <|endoftext|> end",
    "῿\U000323af\U00018e00 new letters", "it's 123 ... !!", "\x00\x1c\x85​", "twice", "twice",
]


@pytest.fixture(scope="module")
def ranked():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


def test_queries_against_the_libraries(spark, sf_dir, table, ranked):
    counts = Tokenizer.from_file(JSON)
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents").collect()}
    for r in op3_byte_bpe(spark, sf_dir).collect():
        ids = ranked.encode_ordinary(texts[r["doc_id"]])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    rows = op5_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(counts.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"]) == (n, len(texts[r["doc_id"]].encode()))
        assert r["over_limit"] == (n > 512)


def test_edges_and_clashing_columns(spark, ranked):
    docs = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(EDGES)],
                                 "doc_id long, text string, token_ids string, decoded string")
    out = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert sorted(out.columns) == ["decoded", "doc_id", "text", "token_ids", "token_starts"]
    out = out.withColumns({
        "ids": byte_bpe.unpacked("token_ids"), "starts": byte_bpe.unpacked("token_starts"),
        "again": byte_bpe.decode_text(byte_bpe.decode("token_ids", RANKS)),
    })
    for r in out.collect():
        text = r["text"] or ""
        assert r["ids"] == ranked.encode_ordinary(text)
        assert r["again"] == text == bytes(r["decoded"]).decode()
        assert r["starts"] == sorted(r["starts"]) and len(r["starts"]) == len(r["ids"])
        assert all(0 <= s < len(text) for s in r["starts"])
    empty = byte_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.isEmpty()


def test_split_characters(spark, ranked):
    text = "漢🏽"
    ids = ranked.encode_ordinary(text)
    encoder = byte_bpe.encoder_of_ranks(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    own, starts = encoder.encode(text)
    assert own.tolist() == ids and set(starts.tolist()) <= {0, 1}
    cut = spark.createDataFrame([(bytearray(struct.pack("<I", ids[0])),)], "ids binary")
    (row,) = cut.select(byte_bpe.decode("ids", RANKS).alias("d")).collect()
    assert bytes(row["d"]) == ranked.decode_single_token_bytes(ids[0])


def test_random_texts(ranked):
    rng = random.Random(5)
    encoder = byte_bpe.encoder_of_ranks(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for _ in range(1500):
        text = "".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x2FFFF), 32, 97]))
                       for _ in range(25))
        assert encoder.encode(text)[0].tolist() == ranked.encode_ordinary(text)


def test_chunks_give_the_whole_text_s_count():
    rng, encoder, library = random.Random(3), encoder_of_json(JSON), Tokenizer.from_file(JSON)
    parts = ["a", "word ", "\n\n", " ", "   ", "1234", "é", "漢字", "<|endoftext|>", "'s ", "!!"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(200)))
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert count_in_chunks(encoder, text, rng.randrange(5, 60), rng.randrange(1, 9)) == n


def test_counts_of_edges(spark):
    library = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "doc_id long, text string")
    for r in docs.withColumn("n", count_tokens("text", JSON, 1000, 10)).collect():
        assert r["n"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert docs.limit(0).select(count_tokens(F.col("text"), JSON)).isEmpty()
