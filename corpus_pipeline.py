"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Defined results, of every stage: a null text is an empty one, which the quality rules reject; null ids and sources are values like any other; rows equal in id and text
count as one from near-dedup on, other ties go to the smaller id and then to the text's hash; an
empty table gives an empty table; extra columns are carried unchanged up to the last stage, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwright.llm import byte_bpe, quality_rules, secret_scan, simhash_dedup, source_mix
from docwright.plans.durable import shared_folder
from docwright.plans.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept by their posterior, which short ones may well reach."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return quality_rules.judge(held, ["doc"]).filter("accepted").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs, repository=F.concat_ws("/", "source", "lang"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each take of a document by the mix."""
    return source_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the digests of each text's ids and of what they decode to."""
    return byte_bpe.round_trip(docs, ["doc_id", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: Fingerprints, the permutation of blocks and the token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    ship(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
