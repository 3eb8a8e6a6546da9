"""Corpus preparation as a chain of stages over documents.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Document ids
identify documents: rows that repeat an id stay or go together. Other columns than those of documents are left out, an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import read_table, table_of
from loomtext.llm.language_id import UNKNOWN, identify_languages
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.packing import pack
from loomtext.llm.pii import replace_entities, session_secret
from loomtext.llm.toxicity import fit, learnable, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what has a language, and sets lang to the language found.

    A null or empty text and one without a letter has none and goes; so does everything where no row has a lang to learn from.
    """
    found = identify_languages(docs, docs, carry=COLUMNS).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"carry_{c}")).alias(c) for c in COLUMNS])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is not predicted to be toxic.

    Where labels hold not both kinds, all texts have one score; a null text is scored as one without words.
    """
    model = fit(docs, read_table(spark, sf_dir, "labels"), learnable)
    scored = score_toxicity(docs, model, carry=COLUMNS).where(F.col("predicted") == 0)
    return scored.select(*[F.col(f"carry_{c}").alias(c) for c in COLUMNS])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    Null and empty texts are like nothing and stay; so do rows without an id; rows that repeat an id go together.
    """
    dropped = table_of(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates and counts the characters anew. A null text stays null, and so does its count."""
    return replace_entities(docs, session_secret(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences. A null text is the end token alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL expresses none of the learned stages; the tests hold the chain against a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table_of(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
