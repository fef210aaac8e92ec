"""Languages, spellings and importance over all documents, and the SQL of the last two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, langid, spelling
from .common import read_table
from .learning import fold


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every text of the documents, learnt from three of four folds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.train_languages(docs))
    held_out = F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their frequent forms."""
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw documents towards the texts of the benchmark."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.draw(docs, read_table(spark, sf_dir, "benchmark").select("text"))


def _crc32_table() -> list[int]:
    """What each byte does to a crc32, from its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 * (c & 1)) for c in table]
    return table


def _crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text, byte by byte from their hexadecimal digits."""
    digits = f"hex(encode({text}))"
    numbers = (
        f"list_transform(range(1, length({digits}) // 2 + 1), "
        f"lambda i: ('0x' || substr({digits}, 2 * i - 1, 2))::BIGINT)"
    )
    step = f"lambda c, b: xor(c >> 8, ({_crc32_table()}::BIGINT[])[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), {step}), 4294967295::BIGINT)"


_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
    FROM documents
), lowered AS (
    SELECT id, {_ASCII_LOWER.format("run")} AS run, count(*) AS times FROM runs GROUP BY 1, 2
), hashed AS MATERIALIZED (
    SELECT run, times, {_crc32_sql("id || ':' || run")} AS h FROM lowered
), counted AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                ELSE run END AS word, sum(times)::BIGINT AS n
    FROM hashed GROUP BY 1
), words AS MATERIALIZED (
    SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5
), shorter AS MATERIALIZED (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM words, unnest(range(0, length(word))) t (i)
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n
    FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), ranked AS (
    SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
    FROM pairs
), formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.other_n >= 5 * w.n THEN x.other END AS form,
           CASE WHEN x.other_n >= 5 * w.n THEN x.other_n END AS form_n
    FROM words w LEFT JOIN ranked x ON x.word = w.word AND x.place = 1
), walk AS (
    SELECT word, word AS reached, 0 AS steps FROM formed
    UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN formed f ON f.word = w.reached WHERE f.form IS NOT NULL
), roots AS (
    SELECT word, arg_max(reached, steps) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""


def _features_sql(table: str, key: str) -> str:
    words = f"""regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")},
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
    return f"""(SELECT {key} AS id, unnest(list_concat(w,
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
        FROM (SELECT *, {words} AS w FROM {table}))"""


# A text of 20 words has 20 + 19 + 18 features, so their number tells which are long enough.
_OP13_SQL = f"""
WITH numbered AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, text FROM documents
), features AS MATERIALIZED (
    SELECT id, feature, count(*) AS n FROM {_features_sql("numbered", "row")} GROUP BY 1, 2
), aims AS MATERIALIZED (
    SELECT feature, count(*) AS n FROM {_features_sql("benchmark", "item_id")} GROUP BY 1
), hashed AS MATERIALIZED (
    SELECT feature, {_crc32_sql("feature")} % 10000 AS bucket
    FROM (SELECT feature FROM features UNION SELECT feature FROM aims)
), source AS (
    SELECT bucket, sum(n) AS s FROM features JOIN hashed USING (feature) GROUP BY 1
), target AS (
    SELECT bucket, sum(n) AS t FROM aims JOIN hashed USING (feature) GROUP BY 1
), totals AS (
    SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM source) AS all_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM target) AS all_t
), gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)
           / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain
    FROM source FULL JOIN target USING (bucket) CROSS JOIN totals
), weights AS (
    SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY 1
), noisy AS (
    SELECT row, doc_id, ('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE AS h
    FROM numbered
), scored AS (
    SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(h / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM noisy LEFT JOIN weights ON row = id
), ranked AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 57
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""

QUERIES = {
    "op11_langid": op11_langid,
    "op12_spelling": op12_spelling,
    "op13_importance": op13_importance,
}

ORACLES = {"op12_spelling": _OP12_SQL, "op13_importance": _OP13_SQL}
