"""Filled review sheets: judgments carried over to a new sheet, rows that people added, and what the labels say.

A row's identity is its clip, provider, kind and expected words, and the number
of its occurrence among rows that agree in all four.  Rows that people added
have ``source`` human and no weight; each stands for itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("clip_id", "provider", "kind", "expected")
JUDGMENTS = ("needs_listen", "failure_code", "severity", "note")
#: Codes of findings that turned out to be no error of the transcript.
UNREAL = ("", "NO-ERROR")


def numbered(sheet: DataFrame) -> DataFrame:
    """``sheet`` with ``occurrence`` (from 1) among rows of one identity, in order of their numbers on the sheet."""
    order = Window.partitionBy(*IDENTITY).orderBy(F.col("finding_id").cast("long"))
    return sheet.withColumn("occurrence", F.row_number().over(order))


def touched() -> Column:
    """Whether a person has judged or noted anything in the row."""
    return reduce(Column.__or__, [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in JUDGMENTS])


def done() -> Column:
    """A row is done when it has a code and a severity."""
    return (F.coalesce("failure_code", F.lit("")) != "") & (F.coalesce("severity", F.lit("")) != "")


def exported(sheet: DataFrame) -> DataFrame:
    """What leaves the labelling page: the detector's rows, and of people's rows those that were touched."""
    return sheet.filter((F.col("source") != "human") | touched())


def reattached(sheet: DataFrame, filled: DataFrame) -> DataFrame:
    """``sheet`` with the judgments that ``filled`` has for rows of the same identity, and the rows that people added there."""
    keys = [F.col(k).cast("string").alias(f"__{k}") for k in IDENTITY]
    old = numbered(filled.filter("source != 'human'")).select(*keys, F.col("occurrence").alias("__n"), *[F.col(c).alias(f"__{c}") for c in JUDGMENTS])
    own = numbered(sheet)
    same = [F.col(k).cast("string") == F.col(f"__{k}") for k in IDENTITY] + [F.col("occurrence") == F.col("__n")]
    judged = own.join(old, same, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in JUDGMENTS else F.col(c) for c in sheet.columns])
    people = exported(filled.filter("source = 'human'")).select(*[F.col(c).cast(t).alias(c) for c, t in sheet.dtypes])
    return judged.unionByName(people)


def weight() -> Column:
    return F.coalesce(F.col("weight"), F.lit(1.0))


def taxonomy_summary(labelled: DataFrame, keys: tuple[str, ...] = ("provider", "tier"), severity: str = "S1") -> DataFrame:
    """By ``keys`` the rows, those done, and how many findings of the population they stand for, in all and at ``severity``."""
    worst = F.sum(F.when(F.col("severity") == severity, weight()).otherwise(0.0))
    return labelled.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(done().cast("int")).alias("done"), F.sum(weight()).alias("findings"), worst.alias("worst"))


def label_distribution(labelled: DataFrame, keys: tuple[str, ...] = ("provider", "tier")) -> DataFrame:
    """Weighted findings of each code and severity, of the rows that are done."""
    return labelled.filter(done()).groupBy(*keys, "failure_code", "severity").agg(F.count("*").alias("rows"), F.sum(weight()).alias("findings"))


def missed_rate(labelled: DataFrame, keys: tuple[str, ...] = ("provider",)) -> DataFrame:
    """Errors that people added over those and the detector's real ones, on the rows that were judged."""
    real = done() & ~F.col("failure_code").isin(*UNREAL)
    found, missed = (F.sum((real & (F.col("source") == s)).cast("int")) if s == "human" else F.sum((real & (F.col("source") != "human")).cast("int")) for s in ("detector", "human"))
    counts = labelled.groupBy(*keys).agg(found.alias("found"), missed.alias("missed"))
    return counts.withColumn("missed_rate", F.try_divide(F.col("missed"), F.col("found") + F.col("missed")))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: findings that both sheets have done, and on which share of them code and severity agree."""
    brief = lambda d, s: numbered(d.filter(done())).select(*IDENTITY, "occurrence", F.col("failure_code").alias(f"code_{s}"), F.col("severity").alias(f"severity_{s}"))
    both = brief(first, "a").join(brief(second, "b"), [*IDENTITY, "occurrence"])
    share = lambda c: F.avg((F.col(f"{c}_a") == F.col(f"{c}_b")).cast("int"))
    return both.agg(F.count("*").alias("findings"), share("code").alias("code_agreement"), share("severity").alias("severity_agreement"))


def coverage(sheet: DataFrame, findings: DataFrame) -> DataFrame:
    """By kind how many findings there are, how many are on the sheet, and their share."""
    on = sheet.filter("source != 'human'").groupBy("kind").agg(F.count("*").alias("on_sheet"))
    all_ = findings.groupBy("kind").agg(F.count("*").alias("found"))
    out = all_.join(F.broadcast(on), "kind", "left").withColumn("on_sheet", F.coalesce("on_sheet", F.lit(0).cast("long")))  # a row for each kind
    return out.withColumn("share", F.col("on_sheet") / F.col("found"))
