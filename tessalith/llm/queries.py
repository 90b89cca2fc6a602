"""The registered query of each operator of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith.llm import decontamination, fertility, language_id, licenses, mixing, paragraphs, quality_model, set_join, token_files, toxicity
from tessalith.llm.oracles import ORACLES
from tessalith.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component of links."""
    return set_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of a passage that stands in several documents, and whether it is removed."""
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts, and the verdict by bands on tokens of public vocabularies."""
    docs = table(spark, sf_dir, "documents")
    return fertility.judge(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and where its copies begin in the sorted training order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("first_position", F.round("first_position", 6))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from token-id files."""
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "position")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence template that a document holds, with the segment that is most like it."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in a document where a benchmark item stands, with its edit distance."""
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: shipped(f)
    for f in (
        op1_set_join,
        op2_paragraphs,
        op3_fertility,
        op4_toxicity,
        op5_mixing,
        op6_quality,
        op7_language,
        op8_token_ids,
        op9_licenses,
        op10_decontamination,
    )
}

__all__ = ["ORACLES", "QUERIES"]
