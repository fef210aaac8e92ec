"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents as encode
from .common import read_table
from .mixing import mixed_documents
from .ngram_join import one_of_each_group
from .pii import replace_mentions
from .toxicity import threshold_of, toxicity_score, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents whose score reaches the threshold of their language.

    All columns stay as they are, whatever their names; without a column ``lang``
    the common threshold holds. Null and empty texts are scored as empty. Rows
    that repeat are judged alike, ids play no part in it, and a null one does not
    matter. Without labels, or on an empty table, nothing is learnt and every score
    is low.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, held_out=None)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.where(toxicity_score(docs, model) < threshold_of(model, lang))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of the smallest id.

    Rows are told apart by id and text, so where an id has two texts each is
    judged by its own; rows that repeat both are one document, of which one row
    stays. A null id comes after all others. Null, empty and blank texts
    stay. All columns stay as they are. An empty table stays empty.
    """
    return one_of_each_group(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in place of personal data; n_chars follows the text.

    Only these two columns change (n_chars only where there is one, null for a null
    text). Equal texts are replaced alike, whatever their ids, null or repeated;
    null and empty texts and an empty table stay as they are. A column
    n_replaced of the input is kept.
    """
    held = "__n_replaced"
    replaced = replace_mentions(docs.withColumnsRenamed({"n_replaced": held})).drop("n_replaced")
    replaced = replaced.withColumnsRenamed({held: "n_replaced"})
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.length("text").cast("long"))
    return replaced.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the weights of their sources ask.

    All columns stay as they are. A null source is one of its own. Rows without
    words have size 0 and as many expected copies as others of their source, none
    where the source has no words at all. Rows that repeat, and null ids, are
    drawn like any other row. An empty table stays empty.
    """
    return mixed_documents(docs)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put tokens, and the text decoded from them, in the place of every text.

    Added are token_ids, token_starts, n_tokens and decoded_text, in place of
    columns of these names; all others but the text and n_chars stay. Null
    texts are encoded as empty. Every row is encoded by itself, so repeated rows
    and null ids do no harm. An empty table stays empty.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    # Workers that other stages use too remember fewer pieces.
    encoded = encode(docs, path, pattern, offsets=True, decoded=True, most_pieces=60_000)
    added = ("text", "n_chars", "token_ids", "token_starts", "n_tokens", "decoded_text", "decoded")
    return encoded.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in added], "token_ids", "token_starts",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.decode("decoded", "UTF-8").alias("decoded_text"),
    )
