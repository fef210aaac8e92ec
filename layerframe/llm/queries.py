"""The operators over whole tables, and the same in SQL where it can say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    chat_format,
    corpus_queries,
    embedding_dups,
    imatch,
    mixing,
    ngram_join,
    pii,
    quality,
    token_counts,
    toxicity,
)
from .common import code_points, read_table, text_or_empty
from .learning import fold
from .neighbours import with_next_text


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, digested from the output."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    out = chat_format.format_conversations(
        rows.unionByName(probe), _tokenizer_file("byte_bpe_50k.json")
    )
    out = out.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat_format.formatted_turns(F.col("formatted")).alias("turns"),
        chat_format.masked_text({c: F.col(c) for c in out.columns}).alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(F.array_join(said, "")).alias("turns_sha256"),
        code_points(F.col("loss")).alias("loss_chars"),
        _sha256(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPED = r"regexp_replace({0}, '(\[|<)(\\*(?:/?INST\]|/s>))', '\1\\\2', 'g')"

_OP1_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_PROBE}'
    UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 17)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings."""
    return embedding_dups.near_vectors(read_table(spark, sf_dir, "embeddings"))


_OP2_SQL = """
WITH RECURSIVE pairs AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT a AS vec_id, (SELECT count(*) FROM pairs p WHERE p.a = r.a) AS n_links,
       min(b) AS component_id, min(b) = a AS kept
FROM reach r GROUP BY a
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of the documents."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_documents(
        docs, _tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True
    )
    return encoded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of the documents, of an edited text and the next."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = imatch.lexicon(docs)
    placed = with_next_text(docs)
    kept = F.length("text") - F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), kept),
        F.substring("next_text", F.lit(1), F.length("text") - kept),
    )
    facts = F.struct(
        "doc_id", code_points(F.col("text")).alias("n_chars"), _sha256(F.col("edited")).alias("edited_sha256"), "extra"
    )
    rows = placed.withColumn("edited", F.when(~F.col("extra"), edited)).select(
        "bucket", "place", "text", "edited", facts.alias("facts")
    )
    marked = imatch.fingerprints(rows, ["bucket", "place"], ["text", "edited"], terms, keep=["facts"])
    along = Window.partitionBy("bucket").orderBy("place")
    nexts = marked.withColumn("next_fingerprint", F.lead("text_fingerprint").over(along))
    return nexts.where("not facts.extra").select(
        "facts.doc_id",
        "facts.n_chars",
        "facts.edited_sha256",
        F.col("text_fingerprint").alias("fingerprint"),
        F.col("edited_fingerprint"),
        imatch.likeness(F.col("text_fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(F.col("text_fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every text of the documents."""
    text = text_or_empty("text")
    counted = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_counts.count_tokens("text", _tokenizer_file("byte_bpe_50k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every text of the documents, learnt from three of four folds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"),
        toxicity.toxicity_score(docs, model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_mentions(docs)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labelled rows: 0 poor, 1 usable but toxic, 2 good."""
    return labels.withColumn(
        "grade", F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate every text of the documents and select by the chance of grade 1."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = graded(read_table(spark, sf_dir, "labels"))
    model = quality.train_quality(docs, labels, F.col("grade"))
    rated = quality.rate(docs, model).select(
        "doc_id", "expected_grade", "tail_probability", F.col("selected").alias("kept")
    )
    return rated.withColumn("held_out", F.coalesce(fold("doc_id") == 2, F.lit(False)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights of their sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_OP8_SQL = r"""
WITH sized AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('mix' || coalesce(doc_id::VARCHAR, '')) AS hash
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source) - 1) % 3 + 1] AS weight,
           source_size * 3.0::DOUBLE AS cap
    FROM sizes
), levels AS (
    SELECT *, (sum(source_size) OVER () - (sum(cap) OVER filling - cap))
              / (sum(weight) OVER () - (sum(weight) OVER filling - weight)) AS level
    FROM weighed
    WINDOW filling AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), targets AS (
    SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix' || s.source), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS offset_,
           row_number() OVER (PARTITION BY s.source
               ORDER BY lpad(length(bin(s.size))::VARCHAR, 2, '0') || rpad(substr(bin(s.size), 2, 3), 3, '0'),
                        substr(s.hash, 1, 2), s.hash, s.size, s.doc_id NULLS FIRST) AS place
    FROM sized s JOIN targets t USING (source)
)
SELECT doc_id, size, source_size, target,
       ((floor(offset_ + rate * place) - floor(offset_ + rate * (place - 1))) * size)::BIGINT AS taken
FROM placed
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all documents by shared runs of five words."""
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_OP10_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
                               lambda w: w <> '') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
                                          lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), classes AS MATERIALIZED (
    SELECT list_sort(s) AS s, min(doc_id) AS class_id, count(*) AS copies, len(any_value(s)) AS n
    FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), shingles AS MATERIALIZED (
    SELECT class_id, n, copies, unnest(s) AS shingle FROM classes
), pairs AS MATERIALIZED (
    SELECT a.class_id AS a, b.class_id AS b, any_value(b.copies) AS copies
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class_id <> b.class_id
        AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
    GROUP BY a.class_id, b.class_id
    HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), reach AS (
    SELECT class_id AS a, class_id AS b FROM classes
    UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), groups AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), results AS (
    SELECT c.s, c.class_id, c.copies - 1 + coalesce((SELECT sum(p.copies) FROM pairs p WHERE p.a = c.class_id), 0) AS n_links,
           g.component_id
    FROM classes c JOIN groups g ON g.a = c.class_id
)
SELECT d.doc_id, coalesce(r.class_id, d.doc_id) AS class_id, coalesce(r.n_links, 0)::BIGINT AS n_links,
       coalesce(r.component_id, d.doc_id) AS component_id,
       coalesce(r.component_id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN results r ON list_sort(d.s) = r.s
"""


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_embedding_dups": op2_embedding_dups,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_imatch": op4_imatch,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    **corpus_queries.QUERIES,
}

ORACLES = {
    "op1_chat_formatting": _OP1_SQL,
    "op2_embedding_dups": _OP2_SQL,
    "op8_mixing": _OP8_SQL,
    "op10_ngram_join": _OP10_SQL,
    **corpus_queries.ORACLES,
}
