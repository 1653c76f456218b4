"""The queries of this subpackage: ``opN_<name>`` over whole tables, and their SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import covertree, digest, htmlmain, langid, mixing, packing, quality, resample, secrets, simhash, spelling, toxicity, urlfilter
from millrace.sources.tables import spread, table


def op1_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op2_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(spread(table(spark, sf_dir, "documents")))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "offending")


def op5_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(spread(table(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")))


def op9_host_suffix_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(spread(table(spark, sf_dir, "pages")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spread(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spread(table(spark, sf_dir, "documents")))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    found = {"op6_url_filter": urlfilter, "op11_spelling_variants": spelling, "op12_importance_resample": resample, "op13_quartile_digest": digest}
    return {name: module.oracle() for name, module in found.items()}
