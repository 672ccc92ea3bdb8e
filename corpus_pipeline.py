"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame
with the columns of documents (the last one: tokens). run() writes each result as Parquet in the
shared folder and reads it again for the next stage. Null texts and texts without letters go in the
first stage; rows that repeat a document count as copies of it; other columns pass through all
stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import byte_bpe, cube_mixing, language_id, parity_join, pii
from pixelmill.llm.common import materialize, read_table
from pixelmill.llm.registry import BPE_RANKS, public_tokenizers


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language models reject: no letters, or unlike every language."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of linked documents."""
    return parity_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; n_chars follows the text."""
    out = pii.find(docs, mask=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document that is taken twice comes twice."""
    return cube_mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return byte_bpe.encode(docs, ranks=BPE_RANKS, pattern=public_tokenizers.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("language_id", languages),
    ("parity_join", near_duplicates),
    ("pii", personal_data),
    ("cube_mixing", mix),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = materialize(out, name)
    return out


ORACLE_SQL = None
