"""From a transcript cache and a manifest to scores, summaries, paired tests and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessalith.functions import scores as S
from tessalith.functions import stats
from tessalith.functions import text as T
from tessalith.functions.normalise import normalise
from tessalith.shared import written

CLIP = ("clip_id", "provider", "accent", "tier", "domain", "duration")
#: Terms up to which a lexicon is a literal array in the plan; a larger one is joined.
LITERAL_TERMS = 2000


def lexicon_array(terms) -> Column:
    return F.array(*map(F.lit, sorted(terms))).cast("array<string>")


def with_lexicon(pairs: DataFrame, lexicon: DataFrame, key: tuple[str, ...] = ("provider", "clip_id"), columns: tuple[str, ...] = ("reference", "hypothesis")) -> DataFrame:
    """``pairs`` with ``__lexicon``: all terms if they are few, else the terms that the row's texts hold.

    A lookup in an array is linear, so a large lexicon is cut to each row's own
    words first, by a join on words; that is exact, because only words of the
    row are ever looked up.  ``key`` must be unique then.
    """
    terms = lexicon.select(F.col(lexicon.columns[0]).alias("__term")).distinct()
    some = [r[0] for r in terms.limit(LITERAL_TERMS + 1).collect()]
    if len(some) <= LITERAL_TERMS:
        return pairs.withColumn("__lexicon", lexicon_array(some))
    tokens = F.array_distinct(F.flatten(F.array(*[F.array_union(T.lexed(F.coalesce(F.col(c), F.lit(""))), T.words(F.coalesce(F.col(c), F.lit("")))) for c in columns])))
    own = pairs.select(*key, F.explode(tokens).alias("__term")).join(terms, "__term").groupBy(*key).agg(F.collect_set("__term").alias("__known"))
    return pairs.join(own, list(key), "left").withColumn("__lexicon", F.coalesce("__known", F.array().cast("array<string>"))).drop("__known")


def normalised(pairs: DataFrame, columns: tuple[str, ...] = ("reference", "hypothesis")) -> DataFrame:
    return pairs.withColumns({c: normalise(F.col(c)) for c in columns})


def merge(cache: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cached transcripts with their clip's columns; orphans of either side go.

    The manifest is narrowed first, so that little of it moves whichever way
    the join runs; Spark sends it to all workers while its size allows that.
    """
    clip = manifest.select("clip_id", "accent", "tier", "domain", "duration", F.col("transcript").alias("reference"))
    return cache.withColumnRenamed("text", "hypothesis").join(clip, "clip_id")


def with_parts(clips: DataFrame, lexicon: DataFrame, key: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Clips with a normalised ``reference``, its stripped form and its parts: once for each clip, before its answers are joined to it.

    Only for lexicons that stand in the plan; a larger one is cut to each pair's words.
    """
    if lexicon.limit(LITERAL_TERMS + 1).count() > LITERAL_TERMS:
        return clips
    return _referenced(with_lexicon(clips, lexicon, key, ("reference",))).drop("__lexicon")


def _referenced(pairs: DataFrame) -> DataFrame:
    out = pairs.withColumn("__stripped_ref", T.strip_spoken_punctuation(F.col("reference")))
    return out.withColumn("__ref", S.reference_parts(F.col("reference"), F.col("__lexicon"))).withColumn("__stripped_words", T.words(F.col("__stripped_ref")))


def _taken_apart(pairs: DataFrame, lexicon: DataFrame, key: tuple[str, ...] = ("provider", "clip_id")) -> DataFrame:
    """Pairs with the parts of both sides, and both texts without spoken punctuation."""
    pairs = with_lexicon(pairs, lexicon, key)
    pairs = (pairs if "__ref" in pairs.columns else _referenced(pairs)).withColumn("__text", F.coalesce("hypothesis", F.lit("")))
    pairs = pairs.withColumn("__stripped_hyp", T.strip_spoken_punctuation(F.col("__text")))
    return pairs.withColumn("__hyp", S.hypothesis_parts(F.col("reference"), F.col("__ref"), F.col("__text"), F.col("__lexicon")))


def score_clips(merged: DataFrame, lexicon: DataFrame, normalised_already: bool = False, keep: tuple[str, ...] = CLIP) -> DataFrame:
    """The kept columns and the sixteen scores of every (reference, hypothesis)."""
    pairs = _taken_apart(merged if normalised_already else normalised(merged), lexicon)
    outcomes = S.outcomes(S.pair_of(F.col("__ref"), F.col("__hyp"), F.col("__lexicon")))
    made = pairs.select(*keep, "reference", "__text", "__stripped_ref", "__stripped_words", "__stripped_hyp", outcomes.alias("__o"))
    # Where there is no spoken punctuation on either side, the rate without it is the rate.
    same = (F.col("reference") == F.col("__stripped_ref")) & (F.col("__text") == F.col("__stripped_hyp"))
    stripped = F.when(same, F.col("__o.wer")).otherwise(S._rate(F.col("__stripped_words"), T.words(F.col("__stripped_hyp"))))
    return made.select(*keep, *[c.alias(k) for k, c in S.counts(F.col("__o"), stripped).items()])


# --- summaries -----------------------------------------------------------------


def _sum(name: str) -> Column:
    return F.sum(name)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def summary_columns() -> dict[str, Column]:
    """The headline: word error rate is a mean over clips, everything else a ratio of sums."""
    wer, stripped = F.avg("wer"), F.avg("wer_spoken_punct_removed")
    recall = _ratio(_sum("drug_correct"), _sum("drug_mentions"))
    precision = _ratio(_sum("drug_hyp_mentions") - _sum("drug_false_positive"), _sum("drug_hyp_mentions"))
    return {
        "clips": F.count("*"),
        "wer": wer,
        "wer_spoken_punct_removed": stripped,
        "wer_spoken_punct_share": F.try_divide(wer - stripped, wer),
        "drug_mentions": _sum("drug_mentions"),
        "drug_accuracy": recall,
        "drug_hyp_mentions": _sum("drug_hyp_mentions"),
        "drug_false_positives": _sum("drug_false_positive"),
        "drug_precision": precision,
        "drug_f1": F.try_divide(2 * precision * recall, precision + recall),
        "drug_substitutions": _sum("drug_substitution"),
        "doses": _sum("doses"),
        "dose_value_accuracy": _ratio(_sum("dose_correct") + _sum("dose_unit_error"), _sum("doses")),
        "dose_value_errors": _sum("dose_value_error"),
        "dose_unit_errors": _sum("dose_unit_error"),
        "negation_cues": _sum("negation_cues"),
        "negation_preservation": _ratio(_sum("negation_preserved"), _sum("negation_cues")),
    }


def cost_columns() -> dict[str, Column]:
    """Cost per hour of audio and the exact median latency."""
    return {"cost_per_audio_hour": F.try_divide(F.sum("cost_usd"), F.sum("audio_seconds") / 3600), "median_latency_ms": F.median("latency_ms")}


def cost_per_hour(merged: DataFrame) -> DataFrame:
    return merged.groupBy("provider").agg(*[c.alias(k) for k, c in cost_columns().items()])


COSTS = ("audio_seconds", "cost_usd", "latency_ms")


def summarise(per_clip: DataFrame, merged: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """One row per provider (and ``by``; null is a group).

    Without ``by`` cost and latency go along: out of the same pass where the
    scores have kept the columns ``COSTS``, else from ``merged`` where it is given.
    """
    keys = ["provider", *([by] if by else [])]
    kept = by is None and set(COSTS) <= set(per_clip.columns)
    out = per_clip.groupBy(*keys).agg(*[c.alias(k) for k, c in (summary_columns() | (cost_columns() if kept else {})).items()])
    return out.join(cost_per_hour(merged), "provider", "left") if by is None and merged is not None and not kept else out


def summarise_all(per_clip: DataFrame, by: tuple[str, ...] = ("tier", "domain", "accent")) -> DataFrame:
    """The headline and every breakdown in one pass: breakdown, level, provider and the headline columns."""
    sets = [[F.col("provider")], *[[F.col("provider"), F.col(b)] for b in by]]
    level = reduce(lambda rest, b: F.when(F.grouping(b) == 0, F.col(b).cast("string")).otherwise(rest), reversed(by), F.lit(None).cast("string"))
    name = reduce(lambda rest, b: F.when(F.grouping(b) == 0, F.lit(b)).otherwise(rest), reversed(by), F.lit("all"))
    grouped = per_clip.groupingSets(sets, F.col("provider"), *[F.col(b) for b in by])
    return grouped.agg(name.alias("breakdown"), level.alias("level"), *[c.alias(k) for k, c in summary_columns().items()]).drop(*by)


def collapse_rates(per_clip: DataFrame, keys: tuple[str, ...] = ("provider", "tier")) -> DataFrame:
    """Share of scored clips whose transcript collapsed, as scored and without spoken punctuation."""
    share = lambda c: F.avg((F.col(c) >= S.COLLAPSE).cast("int"))
    return per_clip.groupBy(*keys).agg(F.count("wer").alias("clips"), share("wer").alias("collapse_rate"), share("wer_spoken_punct_removed").alias("collapse_rate_stripped"))


def sanity(per_clip: DataFrame, manifest: DataFrame) -> DataFrame:
    """By provider: scored clips, rates outside [0, 1], and clips whose drug mentions are not those that the manifest lists."""
    listed = F.size(F.filter(F.split("drug_terms", r"\|"), lambda t: t != ""))
    both = per_clip.join(manifest.select("clip_id", listed.alias("__listed")), "clip_id")
    count = lambda c: F.sum(c.cast("int"))
    return both.groupBy("provider").agg(F.count("*").alias("clips"), count(~F.coalesce(F.col("wer").between(0, 1), F.lit(True))).alias("wer_outside"), count(F.col("drug_mentions") != F.col("__listed")).alias("other_mentions"))


def accuracy_without_collapsed(per_clip: DataFrame) -> DataFrame:
    """By provider the entity accuracies over all clips and over those whose transcript did not collapse."""
    whole = F.coalesce(F.col("wer_spoken_punct_removed") < S.COLLAPSE, F.lit(True))
    pairs = {"drug": ("drug_mentions", F.col("drug_correct")), "dose": ("doses", F.col("dose_correct") + F.col("dose_unit_error")), "negation": ("negation_cues", F.col("negation_preserved"))}
    columns = []
    for name, (n, ok) in pairs.items():
        columns += [_ratio(F.sum(ok), F.sum(n)).alias(f"{name}_accuracy"), _ratio(F.sum(F.when(whole, ok)), F.sum(F.when(whole, F.col(n)))).alias(f"{name}_accuracy_whole")]
    return per_clip.groupBy("provider").agg(F.sum((~whole).cast("int")).alias("collapsed"), *columns)


def speaker_bootstrap(per_clip: DataFrame, correct: str = "drug_correct", total: str = "drug_mentions", rounds: int = 200) -> DataFrame:
    """By provider the share of survivors and its 95 % interval, drawn by speaker: clips of one speaker stay together.

    Every round gives each speaker a weight of Poisson's law, which a hash of
    speaker and round decides; so speakers are summed first, rounds are a sum of
    weighted speakers, and the interval is the same on every run.
    """
    speakers = per_clip.groupBy("provider", "speaker_id").agg(F.sum(correct).alias("c"), F.sum(total).alias("n"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("speaker_id").cast("string"), F.col("round").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = reduce(lambda rest, k: F.when(u < POISSON[k], F.lit(k)).otherwise(rest), reversed(range(len(POISSON))), F.lit(len(POISSON)))
    drawn = speakers.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", times)
    shares = drawn.groupBy("provider", "round").agg(F.try_divide(F.sum(F.col("w") * F.col("c")).cast("double"), F.sum(F.col("w") * F.col("n")).cast("double")).alias("share"))
    intervals = shares.groupBy("provider").agg(F.percentile("share", F.lit(0.025)).alias("low"), F.percentile("share", F.lit(0.975)).alias("high"))
    return speakers.groupBy("provider").agg(F.count("*").alias("speakers"), _ratio(F.sum("c"), F.sum("n")).alias("share")).join(intervals, "provider")


# The distribution function of Poisson's law with mean 1 at 0 to 6.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)


# --- paired tests ----------------------------------------------------------------

#: For each metric the denominator and what counts as survived; a dose with a wrong unit kept its value.
PAIRED = {"drug": ("drug_mentions", ("drug_correct",)), "dose": ("doses", ("dose_correct", "dose_unit_error")), "negation": ("negation_cues", ("negation_preserved",))}


def paired_significance(per_clip: DataFrame, metrics: tuple[str, ...] = tuple(PAIRED)) -> DataFrame:
    """McNemar's test of every two providers on the clips that both have the entity for.

    A clip is a success if all its entities survived.  All metrics and all
    pairs of providers come out of one join on (metric, clip).
    """
    unknown = [m for m in metrics if m not in PAIRED]
    if unknown:
        raise ValueError(f"{unknown} has no binary outcome per clip; choose from {sorted(PAIRED)}")
    entries = [F.when(F.col(PAIRED[m][0]) > 0, F.struct(F.lit(m).alias("metric"), (reduce(Column.__add__, map(F.col, PAIRED[m][1])) == F.col(PAIRED[m][0])).cast("int").alias("ok"))) for m in metrics]
    long = per_clip.select("provider", "clip_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("provider", "clip_id", "e.metric", "e.ok")
    a, b = (long.select("metric", "clip_id", F.col("provider").alias(f"provider_{s}"), F.col("ok").alias(s)) for s in "ab")
    pairs = a.join(b, ["metric", "clip_id"]).filter("provider_a < provider_b")
    both = pairs.groupBy("metric", "provider_a", "provider_b").agg(
        F.count("*").alias("n_pairs"), F.sum("a").alias("a_clips_correct"), F.sum("b").alias("b_clips_correct"),
        F.sum(F.col("a") * (1 - F.col("b"))).alias("a_only"), F.sum(F.col("b") * (1 - F.col("a"))).alias("b_only"),
    )
    return both.withColumn("m", stats.mcnemar(F.col("a_only"), F.col("b_only"))).select(*both.columns, "m.*")


# --- findings --------------------------------------------------------------------

FINDING = (*CLIP[:5], "kind", "expected", "heard", "ref_index")


#: Bytes up to which the findings of distinct pairs of texts are sent to all workers, and what a row has besides its texts.
SENT_BYTES, ROW_BYTES = 32_000_000, 200


def _found(pairs: DataFrame, lexicon: DataFrame, key: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """A row with ``columns`` for each finding of pairs of normalised texts; ``key`` must be unique."""
    pairs = _taken_apart(pairs, lexicon, key)
    ref, hyp, lex = F.col("__stripped_ref"), F.col("__stripped_hyp"), F.col("__lexicon")
    pairs = pairs.withColumn("__r", F.when(ref == F.col("reference"), F.col("__ref")).otherwise(S.reference_parts(ref, lex)))
    again = S.hypothesis_parts(ref, F.col("__r"), hyp, lex)
    pairs = pairs.withColumn("__h", F.when((hyp == F.col("__text")) & (ref == F.col("reference")), F.col("__hyp")).otherwise(again))
    found = S.findings(S.pair_of(F.col("__r"), F.col("__h"), lex))
    rows = pairs.select(*columns, F.posexplode(found).alias("position", "f"))
    return rows.select(*columns, "f.*", "position")


def _found_by_texts(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As ``_found`` by provider and clip, with findings worked out once for each two texts and joined to all their pairs."""
    texts = ("reference", "hypothesis")
    pairs = pairs.select(*CLIP[:5], "reference", F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))
    some = written(_found(pairs.select(*texts).distinct(), lexicon, texts, texts), "texts")
    size = some.agg(F.sum(F.octet_length("reference") + F.octet_length("hypothesis") + ROW_BYTES)).first()[0] or 0
    both = pairs.join(F.broadcast(some) if size <= SENT_BYTES else some, list(texts))
    return both.select(*CLIP[:5], "kind", "expected", "heard", "ref_index", "position")


def all_findings(merged: DataFrame, lexicon: DataFrame, normalised_already: bool = False, repeated: bool = False) -> DataFrame:
    """One row per error, with ``position`` in reading order.

    ``repeated`` says that many pairs have the same two texts: then each two
    texts are judged once.  The result is the same.
    """
    pairs = merged if normalised_already else normalised(merged)
    return _found_by_texts(pairs, lexicon) if repeated else _found(pairs, lexicon, ("provider", "clip_id"), CLIP[:5])


def quotas(totals: dict[str, int], target: int) -> dict[str, int]:
    """Rows to draw from each stratum: equal shares, what small strata leave goes to the largest first."""
    quota = {k: min(n, target // len(totals)) for k, n in totals.items()} if totals else {}
    spare = target - sum(quota.values())
    for k in sorted(totals, key=lambda k: (-totals[k], k)):
        more = min(totals[k] - quota[k], spare)
        quota[k] += more
        spare -= more
    return quota


def draw_key(*columns: str) -> Column:
    """A fixed shuffle: rows are drawn in the order of a hash of their key, the same on every run and partitioning."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def select_findings(findings: DataFrame, target: int = 150, keys: tuple[str, ...] = ("provider", "clip_id", "kind", "ref_index", "position"), kept: bool = False) -> DataFrame:
    """A stratified sample by kind with ``weight`` = findings of the kind over rows drawn of it, so weights sum to the population.

    ``kept`` says that the findings are a written table already.
    """
    findings = findings if kept else written(findings, "findings")  # worked out once for the counts and the draw
    totals = {r.kind: r["count"] for r in findings.groupBy("kind").count().collect()}  # seven kinds at most
    quota = quotas(totals, target)
    if not quota:
        return findings.withColumn("weight", F.lit(1.0))
    take = F.create_map(*[F.lit(x) for k in quota for x in (k, quota[k])])
    weight = F.create_map(*[F.lit(x) for k in quota for x in (k, totals[k] / quota[k] if quota[k] else 1.0)])
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(draw_key(*keys), *keys))
    # A key below the quota's share of the kind's keys, with room to spare, leaves few rows to sort.
    share = F.create_map(*[F.lit(x) for k in quota for x in (k, min(1.0, (quota[k] + 10 * quota[k] ** 0.5 + 50) / totals[k]))])
    near = F.conv(F.substring(draw_key(*keys), 1, 8), 16, 10).cast("double") / 4294967296.0
    few = findings.filter(near < F.element_at(share, F.col("kind")))
    return few.withColumn("__n", nth).filter(F.col("__n") <= F.element_at(take, F.col("kind"))).drop("__n").withColumn("weight", F.element_at(weight, F.col("kind")))


SHEET = (
    "finding_id", "source", "clip_id", "provider", "accent", "tier", "domain", "kind", "expected", "heard",
    "weight", "ref_excerpt", "hyp_excerpt", "auto_flag", "needs_listen", "failure_code", "severity", "note",
)


def review_sheet(selected: DataFrame, merged: DataFrame) -> DataFrame:
    """The sheet a person fills: one row per drawn finding, excerpts around it, judgment columns blank.

    The clips of a short sheet stand in the plan, so that only their pairs are worked out and joined.
    """
    selected = written(selected, "drawn")
    pairs = merged.select("provider", "clip_id", "reference", "hypothesis")
    clips = [r[0] for r in selected.select("clip_id").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(clips) <= LITERAL_TERMS:
        pairs = pairs.filter(F.col("clip_id").isin([c for c in clips if c is not None]))
    shown = selected.join(pairs, ["provider", "clip_id"])
    ref, hyp = T.excerpt_around(F.col("reference"), F.coalesce("hypothesis", F.lit("")), F.col("ref_index"))
    order = Window.orderBy("kind", "clip_id", "provider", "ref_index", "position")  # as many rows as the sheet has
    made = {"finding_id": F.row_number().over(order), "source": F.lit("detector"), "weight": F.round("weight", 4), "ref_excerpt": ref, "hyp_excerpt": hyp, "auto_flag": F.concat("kind", F.lit(" candidate"))}
    blank = dict.fromkeys(("needs_listen", "failure_code", "severity", "note"), F.lit(""))
    return shown.withColumns(made | blank).select(*SHEET)


def cards(sheet: DataFrame) -> DataFrame:
    """The sheet by clip and provider: one row with its findings as an array, in order of first appearance."""
    entry = F.struct("finding_id", *[c for c in SHEET if c not in ("finding_id", "clip_id", "provider", "accent", "tier", "domain")])
    out = sheet.groupBy("clip_id", "provider").agg(F.min("finding_id").alias("first"), *[F.min_by(c, "finding_id").alias(c) for c in ("accent", "tier", "domain")], F.array_sort(F.collect_list(entry)).alias("findings"))
    return out.withColumn("findings", F.transform("findings", lambda f, i: f.withField("position", i + 1)))


# --- the older sheet: worst clips by priority -----------------------------------------

PRIORITY = (("drug_substitution", "DRUG-SUB candidate"), ("dose_value_error", "DOSE-VAL candidate"), ("negation_lost", "NEG-FLIP candidate"))
ERRORS = ("drug_substitution", "drug_deletion", "dose_value_error", "dose_unit_error", "dose_missing", "negation_lost")


FINE = 99


def select_failures(per_clip: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` failed clips: by priority, then dealt in turn from each (provider, tier), worst first.

    Ties go to the smaller clip id.  ``band`` and ``turn`` say why a row stands where it does.
    """
    errors = [F.col(c) for c in ERRORS if c in per_clip.columns]
    failed = F.greatest(F.coalesce(F.col("wer"), F.lit(0.0)), F.lit(0.0), *[e.cast("double") for e in errors]) > 0
    present = [(k, c, flag) for k, (c, flag) in enumerate(PRIORITY) if c in per_clip.columns]
    band = reduce(lambda rest, x: F.when(F.col(x[1]) > 0, F.lit(x[0])).otherwise(rest), reversed(present), F.lit(len(PRIORITY)))
    band = F.when(failed, band).otherwise(F.lit(FINE))
    flag = reduce(lambda rest, x: F.when(F.col(x[1]) > 0, F.lit(x[2])).otherwise(rest), reversed(present), F.lit("high WER"))
    turn = F.row_number().over(Window.partitionBy("band", "provider", "tier").orderBy(F.col("wer").desc_nulls_last(), "clip_id"))
    dealt = per_clip.withColumns({"band": band, "auto_flag": flag}).withColumn("turn", turn).filter(F.col("turn") <= n)
    # Clips without an error come last and go behind the limit: a filter in front of it would be pushed
    # down to the scan and have every score worked out once more.
    return dealt.orderBy("band", "turn", "provider", "tier", "clip_id").limit(n).filter(F.col("band") < FINE)
