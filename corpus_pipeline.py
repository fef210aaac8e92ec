"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage reads the files that the one before it has written; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerframe.llm import stages
from layerframe.llm.common import read_table
from layerframe.sources.shared import new_shared_path, written_table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.drop_near_duplicates),
    ("pii", stages.replace_personal_data),
    ("mixing", stages.mix_sources),
    ("byte_bpe", stages.encode_documents),
]

ORACLE_SQL = None
"""A trained classifier decides in the first stage, so SQL can't say it."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), new_shared_path(spark, name))
    return docs
