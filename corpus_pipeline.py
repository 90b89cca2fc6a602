"""The corpus pipeline: five stages, each on all that the one before kept.

1. The quality classifier scores every document; rejected ones go.
2. The n-gram Jaccard join forms groups of near copies; of each group the
   document with the smallest id stays.
3. Documents in which a benchmark item stands go.
4. Sources are mixed to their target weights: a document comes out once for
   every copy that the mix takes (none to three), in training order; at most
   one copy of a source is cut, after a whole word.
5. The copies are encoded into token-id files in training order, which is that
   of the rows in the files that stage 4 left; the rows read back from these
   say where each one is (``start`` counts along the training order).

Every function takes (spark, docs, sf_dir).  All but the last return the
columns of ``docs``.  2 and 3 judge texts, so they name a row by a 64-bit hash
of its text and not by its id: rows with a null id are judged like any other,
and of rows that share an id each by its own text.  In 2 a row without id stays
only if none of its group has one, and equal rows with one id are copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith.llm import decontamination, mixing, quality_model, set_join, token_files
from tessalith.llm.storage import written
from tessalith.session import ship_package

QUALITY = 0.5


KEY = "__text_key"


def fresh(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``docs`` begins with."""
    while any(c.lower() == name for c in docs.columns):
        name = f"_{name}"
    return name


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(F.col("text").cast("string")))


def matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``rows`` (some of its long columns, written before), null being equal to null; a few rows go to all workers, many are shuffled."""
    names, out = rows.columns, fresh(docs, "out")
    rows = rows.distinct().toDF(*[f"{out}.{k}" for k in range(len(names))])
    few = rows.limit(set_join.BROADCAST_ROWS + 1).count() <= set_join.BROADCAST_ROWS
    same = [docs[c].eqNullSafe(F.col(f"`{out}.{k}`")) for k, c in enumerate(names)]
    return docs.join(F.broadcast(rows) if few else rows, same, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return quality_model.score(docs, model, keep=docs.columns, name=score).filter(F.col(score) >= QUALITY).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    own = keyed(docs)
    groups = set_join.near_duplicates(own, id_col=KEY).groupBy(KEY).agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("group"))
    rows = own.groupBy("doc_id", KEY).agg(F.count("*").alias("times")).join(groups, KEY)
    rows = written(rows, "groups")
    # The smallest id of a group, one without id last; texts without words are in no group.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(KEY).alias("k"))
    first = rows.filter("n > 0").groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("members")).filter("members > 1")
    others = rows.filter("n > 0").join(first, "group").filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(KEY) == F.col("first.k"))))
    kept = matching(own, written(others.select("doc_id", KEY), "others"), "left_anti")
    again = rows.filter("times > 1 and (n > 0 or doc_id is not null)").select("doc_id", KEY)
    if again.isEmpty():
        return kept.drop(KEY)
    again = written(again, "again")
    copies = matching(kept, again, "left_semi").dropDuplicates(["doc_id", KEY])
    return matching(kept, again, "left_anti").unionByName(copies).drop(KEY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    own = keyed(docs)
    found = decontamination.find_contamination(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY)
    return matching(own, written(found.select(F.col("doc_id").alias(KEY)).distinct(), "contaminated"), "left_anti").drop(KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = mixing.curriculum(docs).select(*docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def place_in_files(docs: DataFrame) -> Column:
    """Where a row stands in the Parquet files that ``docs`` are read from: part by part as a sorted table is written, row by row inside."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(part, F.lit(0).cast("long")), 40) + F.col("_metadata.row_index")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that come from no file are in the order of their ids."""
    ship_package(spark)
    order = place_in_files(docs)
    try:
        docs.select(order)
    except AnalysisException:
        order = None
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), order=order)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_ids),
]

#: A trained classifier and a tokenizer are not SQL; tests/llm/test_pipeline.py holds ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
