"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import decontam, divergence, media, packing, pii, quality, secrets, simhash, substring, toxicity, urlfilter, vectorcodes, warc
from lodestore.llm.common import table


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op2_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_spans(table(spark, sf_dir, "documents"))


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_history(table(spark, sf_dir, "pages"))


def op6_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op9_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op11_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_table(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_latent_decontamination,
        op2_conflict_best_fit,
        op3_blob_ledger_secrets,
        op4_sentence_spans,
        op5_warc_index_merge,
        op6_avi_mjpeg,
        op7_weak_toxicity,
        op8_url_markov_ratio,
        op9_tiled_simhash,
        op10_disclosure_pii,
        op11_walsh_codes,
        op12_source_divergence,
        op13_unlabelled_quality,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_blob_ledger_secrets": secrets.oracle_sql(), "op5_warc_index_merge": warc.ORACLE_SQL, "op11_walsh_codes": vectorcodes.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
