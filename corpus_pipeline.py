"""A corpus pipeline: language filter, near-duplicate removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm.jaccard_join import jaccard_components
from glyphflow.llm.language_id import UNKNOWN, language_of
from glyphflow.llm.packing import best_fit_pack, tokenised_pieces
from glyphflow.llm.pii import redacted
from glyphflow.llm.shared import fresh, table, written


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language; keep all others as they are.

    Rejected is what the classifier gives no language: a null or empty text, a text without
    any letter, and every text where no row has both a text and a label to learn from. Repeated
    rows and null ids are judged like any others; very long texts are read whole; an empty table
    stays empty; further columns are kept, whatever their names.
    """
    return docs.where(language_of(docs)["lang_pred"] != UNKNOWN)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) one document stays: the least doc_id.

    Repeated rows and rows that share a doc_id are documents of their own: of a group's rows with
    the least doc_id one stays. A null doc_id comes after all others. Texts that are null or
    without a word are no one's copies and stay; an empty table stays empty; further columns are
    kept, whatever their names.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        groups = jaccard_components(docs, k=5, percent=80)
        dropped = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    row = fresh(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-numbered")
    groups = written(jaccard_components(numbered, key=row, k=5, percent=80), "pipeline-groups")
    named = groups.join(numbered.select(row, "doc_id"), row)
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(row))).alias("kept"))
    return numbered.join(best.select(F.col(f"kept.{row}").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def personal_data_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and n_chars follows.

    Every row stays. A null text stays null, and so does its n_chars become null; repeated rows
    repeat; an empty table stays empty; further columns are kept, whatever their names.
    """
    return redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences.

    A null or empty text is one piece with the end id alone; longer texts are cut, into as many
    pieces as they need; repeated rows and null ids are packed like any others; an empty table
    gives an empty result; columns other than doc_id and text are left out.
    """
    return best_fit_pack(tokenised_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_filter),
    ("near_duplicates", near_duplicate_filter),
    ("personal_data", personal_data_redaction),
    ("packing", sequence_packing),
]

#: SQL can't express the trained classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
