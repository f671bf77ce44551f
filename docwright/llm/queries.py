"""Registered queries of the operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwright.llm import (
    byte_bpe,
    cross_align,
    filter_audit,
    html_extract,
    license_scan,
    nearest,
    pairwise_quality,
    quality_rules,
    secret_scan,
    simhash_dedup,
    source_mix,
    token_counts,
    url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time; the query takes one day of two years by page id."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 730).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetch_day"))
    return url_filter.judge(captures, url_filter.list_events(spark), ["page_id", "url"])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = source_mix.plan(table(spark, sf_dir, "documents"), ["doc_id"])
    return planned.select("doc_id", "size", "source_size", "target", source_mix.taken().alias("taken"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash_dedup.groups(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "votes")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents name no repository; a source's documents of one language stand for one."""
    repository = F.concat_ws("/", "source", "lang")
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"], repository=repository))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.link_counts(table(spark, sf_dir, "documents"), ["doc_id"])


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


from docwright.llm.oracles import ORACLES  # noqa: E402

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_nearest, op3_url_filter, op4_source_mix, op5_token_counts, op6_simhash_dedup, op7_html_extract,
        op8_quality_rules, op9_secret_scan, op10_license_scan, op11_filter_audit, op12_cross_align, op13_quality_classifier, pipeline,
    )
}
