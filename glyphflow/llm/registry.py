"""The queries of the training-data operators, one ``opN_<name>`` each.

Every query applies its operator to the whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .cross_alignment import cross_alignment
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .language_model import language_model_scores
from .licenses import licence_scan
from .media_ts import transport_streams
from .packing import best_fit_pack, tokenised_pieces
from .pii import pii_report
from .sentencepiece_viterbi import encode
from .shared import doc_bucket, table
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenised_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return best_fit_pack(pieces)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents"), model, check=True)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = doc_bucket("doc_id", 4) == 2
    found = identify_languages(docs, training=~held_out)
    return found.select("doc_id", (doc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), training=doc_bucket("doc_id", 10) != 0)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_streams(table(spark, sf_dir, "documents"), keep_media=False)


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))
    return cross_alignment(table(spark, sf_dir, "documents"), byte_level, public_tokenizers.path("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_embedding_dedup, op3_sentencepiece, op4_license_scans, op5_pii, op6_language_id, op7_token_counts, op8_ngram_jaccard_join, op9_lm_scoring, op10_media_columns, op11_cross_alignment, op12_embedding_whitening, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {}
