"""Accent tiers, entity annotation, the capped stratified draw, and its quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessalith.functions import text as T
from tessalith.functions.normalise import normalise
from tessalith.operators.scoring import draw_key, with_lexicon

ALLOCATION = {"A": 135, "B": 135, "C": 130}
CLINICAL_SHARE, CAP, LEAST_ACCENTS, ENTITY_SHARE = 0.8, 40, 4, 0.55
SHORTEST, LONGEST, LEAST_IN_SPLIT = 3.0, 30.0, 15
TIER_RANKS = (5, 25)


def accent_tiers(stats: DataFrame, ranks: tuple[int, int] = TIER_RANKS, least_in_split: int = LEAST_IN_SPLIT) -> DataFrame:
    """(accent, tier) from (accent, num_clips, in_split): by rank of clips, then by name.

    Accents that the split lacks (null ``in_split``) and the pseudo-accent
    ``all`` go before the ranking; past the last rank an accent needs enough
    clips in the split.  One row per accent, so the one window is small.
    """
    present = stats.filter((F.col("accent") != "all") & F.col("in_split").isNotNull())
    rank = F.row_number().over(Window.orderBy(F.coalesce("num_clips", F.lit(0)).desc(), "accent"))
    tier = F.when(F.col("rank") <= ranks[0], "A").when(F.col("rank") <= ranks[1], "B").when(F.col("in_split") >= least_in_split, "C")
    return present.withColumn("rank", rank).select("accent", tier.alias("tier")).filter("tier is not null")


def stats_from_json(raw: DataFrame, split: str, column: str = "value") -> DataFrame:
    """(accent, num_clips, in_split) from the text of {accent: {num_clips, split: {num_clips}}}; entries that are no object go."""
    entries = F.from_json(F.col(column), "map<string,string>")
    rows = raw.select(F.explode(entries).alias("accent", "entry")).filter(F.col("entry").startswith("{"))
    number = lambda path: F.get_json_object("entry", path).cast("long")
    inside = F.get_json_object("entry", f"$.{split}")
    return rows.select("accent", F.coalesce(number("$.num_clips"), F.lit(0)).alias("num_clips"), F.when(inside.isNotNull(), F.coalesce(number(f"$.{split}.num_clips"), F.lit(0))).alias("in_split"))


def annotate(frame: DataFrame, lexicon: DataFrame, key: tuple[str, ...] = ("clip_id",), normalised_already: bool = False) -> DataFrame:
    """``frame`` with the entity columns, found in the normalised transcript."""
    out = frame.withColumn("__text", F.col("transcript") if normalised_already else normalise(F.col("transcript")))
    out = with_lexicon(out, lexicon, key, ("__text",))
    out = out.withColumns({"__drugs": T.drug_mentions(F.col("__text"), F.col("__lexicon")), "__doses": T.dose_pairs(F.col("__text"))})
    strings = F.transform("__doses", lambda p: F.concat(p["value"].cast("string"), F.lit(" "), p["unit"]))
    made = {"has_drug": F.size("__drugs") > 0, "drug_terms": F.array_join("__drugs", "|"), "has_dose": F.size("__doses") > 0, "dose_strings": F.array_join(strings, "|"), "has_negation": F.col("__text").rlike(T.NEGATION)}
    out = out.withColumns(made).drop("__text", "__lexicon", "__drugs", "__doses")
    return out.withColumn("has_entity", F.col("has_drug") | F.col("has_dose") | F.col("has_negation"))


def draw_sample(frame: DataFrame, tiers: DataFrame, allocation: dict[str, int] | None = None, cap: int = CAP, clinical_share: float = CLINICAL_SHARE, key: Column | None = None, strict: bool = True) -> DataFrame:
    """The stratified draw: per tier first clinical, then general clips, dealt one per accent in turn, entity-bearing first.

    An accent gives at most ``cap`` clips to a tier, both domains together.
    Taking the n-th of every accent in turn is ranking by (n, accent); so each
    domain is a window per accent, a cap, and a window per tier over at most
    ``cap`` rows of each accent.  With ``strict`` a tier that cannot be filled
    is an error: it is never filled up from another tier.
    """
    allocation = allocation or ALLOCATION
    key = draw_key("clip_id") if key is None else key
    pool = frame.drop("tier").join(tiers, "accent").filter(F.col("duration").between(SHORTEST, LONGEST) & F.col("tier").isin(list(allocation)))
    clinical = {t: round(n * clinical_share) for t, n in allocation.items()}
    own = Window.partitionBy("tier", "domain", "accent").orderBy(F.col("has_entity").desc(), key, "clip_id")
    ranked = pool.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= cap)

    def drawn(rows: DataFrame, targets: dict[str, int]) -> DataFrame:
        target = F.create_map(*[F.lit(x) for t in targets for x in (t, targets[t])])
        dealt = F.row_number().over(Window.partitionBy("tier").orderBy("__n", "accent"))
        return rows.withColumn("__dealt", dealt).filter(F.col("__dealt") <= F.element_at(target, F.col("tier"))).drop("__dealt")

    first = drawn(ranked.filter("domain = 'clinical'"), clinical)
    taken = first.groupBy("tier", "accent").agg(F.count("*").alias("__taken"))
    general = ranked.filter("domain = 'general'").join(taken, ["tier", "accent"], "left")
    second = drawn(general.filter(F.col("__n") <= cap - F.coalesce("__taken", F.lit(0))).drop("__taken"), {t: allocation[t] - clinical[t] for t in allocation})
    sample = first.unionByName(second).drop("__n")
    if strict:
        got = {r.tier: r["count"] for r in sample.groupBy("tier").count().collect()}
        short = [f"tier {t}: {got.get(t, 0)} of {n}" for t, n in sorted(allocation.items()) if got.get(t, 0) < n]
        if short:
            raise ValueError(f"too few clips, and no backfill from another tier: {'; '.join(short)}")
    return sample.select(*[c for c in frame.columns if c != "tier"], "tier")


def check_quotas(manifest: DataFrame, allocation: dict[str, int] | None = None, least_accents: int = LEAST_ACCENTS, cap: int = CAP, entity_share: float = ENTITY_SHARE, clinical_share: float = CLINICAL_SHARE) -> DataFrame:
    """(rule, subject, found, wanted) of every quota that the manifest breaks; no row means that it passes.

    Two aggregations of the manifest: by tier and accent, and the clip ids.
    """
    allocation = allocation or ALLOCATION
    spark = manifest.sparkSession
    number = lambda c: F.sum(c.cast("int")).cast("double")
    outside = ~F.col("duration").between(SHORTEST, LONGEST)
    cells = manifest.groupBy("tier", "accent").agg(F.count("*").alias("n"), number(F.col("domain") == "clinical").alias("clinical"), number(F.col("has_entity")).alias("entity"), number(F.coalesce(outside, F.lit(True))).alias("outside"))
    tiers = cells.groupBy("tier").agg(F.sum("n").cast("double").alias("n"), F.countDistinct("accent").cast("double").alias("accents"), (F.sum("clinical") / F.sum("n")).alias("share"))
    wanted = spark.createDataFrame([(t, float(n)) for t, n in allocation.items()], "tier string, wanted double")
    accents = cells.groupBy("accent").agg(F.sum("n").cast("double").alias("n")).agg(F.max_by("accent", F.struct("n", "accent")).alias("accent"), F.max("n").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("outside"), F.lit(0.0)).alias("outside"), F.try_divide(F.sum("entity"), F.sum("n")).alias("entity"))
    ids = manifest.groupBy("clip_id").count().filter("count > 1").agg(F.count("*").cast("double").alias("n"))
    size = float(sum(allocation.values()))

    def rule(name: str, rows: DataFrame, broken: Column, subject: Column, found: Column, want: Column) -> DataFrame:
        return rows.filter(broken).select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"), found.cast("double").alias("found"), want.cast("double").alias("wanted"))

    none = F.lit(None)
    parts = [
        rule("size", total, F.col("n") != size, none, F.col("n"), F.lit(size)),
        rule("tier count", wanted.join(tiers.select("tier", "n"), "tier", "left"), F.coalesce("n", F.lit(0.0)) != F.col("wanted"), F.col("tier"), F.coalesce("n", F.lit(0.0)), F.col("wanted")),
        rule("accents in tier", tiers, F.col("accents") < least_accents, F.col("tier"), F.col("accents"), F.lit(least_accents)),
        rule("clinical share", tiers, F.abs(F.col("share") - clinical_share) > 0.02, F.col("tier"), F.col("share"), F.lit(clinical_share)),
        rule("accent cap", accents, F.col("n") > cap, F.col("accent"), F.col("n"), F.lit(cap)),
        rule("entity share", total, F.coalesce("entity", F.lit(0.0)) < entity_share, none, F.col("entity"), F.lit(entity_share)),
        rule("duration", total, F.col("outside") > 0, none, F.col("outside"), F.lit(0)),
        rule("unique clip_id", ids, F.col("n") > 0, none, F.col("n"), F.lit(0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def sample_sheet(manifest: DataFrame) -> DataFrame:
    """Clips, accents, shares and minutes in all, by tier, by domain and by accent, in one pass."""
    sets = [[], [F.col("tier")], [F.col("domain")], [F.col("tier"), F.col("accent")]]
    share = lambda c: F.avg(c.cast("int"))
    kind = F.when(F.grouping("accent") == 0, "accent").when(F.grouping("tier") == 0, "tier").when(F.grouping("domain") == 0, "domain").otherwise("all")
    measures = [F.count("*").alias("clips"), share(F.col("clinical")).alias("clinical_share"), *[share(F.col(c)).alias(f"{c}_share") for c in ("has_drug", "has_dose", "has_negation", "has_entity")], (F.sum("duration") / 60).alias("minutes")]
    rows = manifest.withColumn("clinical", F.col("domain") == "clinical")
    return rows.groupingSets(sets, F.col("tier"), F.col("domain"), F.col("accent")).agg(kind.alias("breakdown"), *measures)
