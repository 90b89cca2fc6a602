"""A clip manifest and a transcript cache derived from the star schema by integer arithmetic.

One line item is one clip and five synthetic providers transcribe it; what each
gets wrong follows from its keys.  The expressions are SQL text that Spark and
DuckDB read alike, so that query and oracle start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRUGS = ("ring", "bolt", "widget", "gear", "gizmo", "plate", "rod", "anvil")
PROVIDERS = 5
TIER_RANKS = (5, 15)

_NEXT = "CASE drug " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(DRUGS, (*DRUGS[1:], DRUGS[0]))) + " END"

#: One expression after another, each on the columns before it.
CLIP = (
    {
        "clip_id": "l_orderkey * 10 + l_linenumber",
        "accent": "n_name",
        "domain": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'general' ELSE 'clinical' END",
        "duration": "qty",
        "speaker_id": "o_custkey",
        "drug": "split_part(p_name, ' ', 2)",
        "amount": "CAST(CAST(qty AS BIGINT) AS STRING)",
        "unit": "CASE l_linenumber % 4 WHEN 0 THEN 'mg' WHEN 1 THEN 'ml' WHEN 2 THEN 'units' ELSE 'tablets' END",
        "neg": "CASE flag WHEN 'R' THEN 'denies' WHEN 'A' THEN 'no' ELSE 'reports' END",
        "base": "l_orderkey * 7 + l_linenumber * 13",
        "orderkey": "l_orderkey",
    },
    {"reference": "concat('the patient takes ', drug, ' ', amount, ' ', unit, ' daily and ', neg, ' chest pain')", "other": _NEXT},
)
CLIP_COLUMNS = ("clip_id", "accent", "domain", "duration", "speaker_id", "drug", "reference")
ANSWER = (
    {"provider": "concat('p', CAST(k AS STRING))", "code": "(base + k * 31 + orderkey * k) % 20"},
    {
        "hypothesis": """CASE code
            WHEN 0 THEN replace(reference, drug, other)
            WHEN 1 THEN replace(reference, drug, concat(drug, 'xqz'))
            WHEN 2 THEN replace(reference, concat(' ', amount, ' '), concat(' ', amount, '0 '))
            WHEN 3 THEN replace(reference, concat(' ', unit, ' '), ' drops ')
            WHEN 4 THEN replace(reference, concat(' ', neg, ' '), ' has ')
            WHEN 5 THEN replace(reference, ' daily ', ' daily comma ')
            WHEN 6 THEN 'quite other words were written down here'
            WHEN 7 THEN concat(reference, ' and ', other)
            ELSE reference END""",
        "latency_ms": "duration * (10 + k)",
        "cost_usd": "duration * k * 0.0001",
        "audio_seconds": "duration",
    },
)
ANSWER_COLUMNS = (*CLIP_COLUMNS, "provider", "hypothesis", "latency_ms", "cost_usd", "audio_seconds")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("partkey"), F.min("l_quantity").alias("qty"), F.min("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    buyers = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == nations.n_nationkey)
    return lines.join(parts, lines.partkey == parts.p_partkey).join(buyers, F.col("l_orderkey") == buyers.o_orderkey)


def clip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clip's columns follow from; a query that goes through its clips more than once writes these and hands them on."""
    return _line_items(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in CLIP[0].items()])


def _clips_wide(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    out = clip_keys(spark, sf_dir) if keys is None else keys
    return out.selectExpr("*", *[f"{e} AS {c}" for c, e in CLIP[1].items()])


def clips(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """One row per clip: keys, accent, domain, duration, speaker, drug and reference transcript."""
    return _clips_wide(spark, sf_dir, keys).select(*CLIP_COLUMNS)


def answers(spark: SparkSession, sf_dir: str, prepare: Callable[[DataFrame], DataFrame] = lambda clips: clips, keys: DataFrame | None = None) -> DataFrame:
    """One row per clip and provider, with the clip's columns and those that ``prepare`` adds to the clips."""
    clips = _clips_wide(spark, sf_dir, keys)
    ready = prepare(clips)
    out = ready.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PROVIDERS - 1))))
    for step in ANSWER:
        out = out.selectExpr("*", *[f"{e} AS {c}" for c, e in step.items()])
    return out.select(*ANSWER_COLUMNS, *[c for c in ready.columns if c not in clips.columns])


def accent_stats(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    return clips(spark, sf_dir, keys).groupBy("accent").agg(F.count("*").alias("num_clips")).withColumn("in_split", F.col("num_clips"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in DRUGS], "term string")


def _list(step: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in step.items())


#: The same tables as common table expressions for DuckDB.
CLIPS_SQL = f"""
line_items AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey, min(l_quantity) AS qty, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber
), clip_keys AS (
  SELECT {_list(CLIP[0])} FROM line_items JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = partkey
), clips AS (
  SELECT *, {_list(CLIP[1])} FROM clip_keys
), accents AS (
  SELECT accent, count(*) AS num_clips FROM clips GROUP BY accent
), ranked AS (
  SELECT accent, num_clips, row_number() OVER (ORDER BY num_clips DESC, accent) AS rank FROM accents
), tiers AS (
  SELECT accent, CASE WHEN rank <= {TIER_RANKS[0]} THEN 'A' WHEN rank <= {TIER_RANKS[1]} THEN 'B' WHEN num_clips >= 15 THEN 'C' END AS tier FROM ranked
)"""
ANSWERS_SQL = f"""{CLIPS_SQL}, coded AS (
  SELECT clips.*, tier, k, {_list(ANSWER[0])} FROM clips JOIN tiers USING (accent), (SELECT unnest(range({PROVIDERS})) AS k)
), answers AS (
  SELECT *, {_list(ANSWER[1])} FROM coded
)"""
