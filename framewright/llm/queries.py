"""The queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import token_files

    return token_files(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bilinear import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maintext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import encoded, probed

    return probed(encoded(table(spark, sf_dir, "documents")))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op1 SQL computes as well."""
    return op1_divergence(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of op2: a row for each source."""
    d = op2_mixing(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"))


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of op5."""
    return op5_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of op10."""
    return op10_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_divergence, op2_mixing, op3_token_orc, op4_toxicity, op5_language_model, op6_packing, op7_quality, op8_main_text, op9_near_duplicates, op10_mpeg_audio)
    return {f.__name__: f for f in (*all_, base_counts, source_targets, unigram_scores, media_payloads)}


def oracle_sql() -> dict[str, str]:
    """For op1, and for what SQL can express of op2, op5 and op10. The others have columns that SQL can't express
    (pseudorandom draws, encoders, learnt models, formats)."""
    return oracles.all_()
