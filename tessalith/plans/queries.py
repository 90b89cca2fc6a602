"""The registered queries of the transcript operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith import sinks
from tessalith.functions import scores as S
from tessalith.functions import stats
from tessalith.functions import text as T
from tessalith.operators import ingest, integrity, labels, lexicon, sampling, scoring
from tessalith.plans import cases, fixture
from tessalith.plans.fixture import table
from tessalith.functions.normalise import normalise
from tessalith.session import ship_package
from tessalith.shared import new_path, removed, written
from tessalith.sources import tables
from tessalith.sources.tables import members_wanted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


# --- what the queries share ---------------------------------------------------


def tiers(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    return sampling.accent_tiers(fixture.accent_stats(spark, sf_dir, keys), fixture.TIER_RANKS)


def merged(spark: SparkSession, sf_dir: str, parts: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Answers with their clip's tier, and the parts of its reference; the fixture's texts are normalised as they are."""
    prepare = (lambda clips: scoring.with_parts(clips, fixture.lexicon(spark))) if parts else (lambda clips: clips)
    return fixture.answers(spark, sf_dir, prepare, keys).join(F.broadcast(tiers(spark, sf_dir, keys)), "accent")  # a row for each of 25 nations


def scored(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = scoring.CLIP) -> DataFrame:
    return scoring.score_clips(merged(spark, sf_dir, parts=True), fixture.lexicon(spark), normalised_already=True, keep=keep)


def found(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """Every finding; the fixture's texts are made by a pattern, so few of its pairs of texts differ."""
    keys = written(fixture.clip_keys(spark, sf_dir), "clips") if keys is None else keys
    return scoring.all_findings(merged(spark, sf_dir, keys=keys), fixture.lexicon(spark), normalised_already=True, repeated=True)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = fixture.clips(spark, sf_dir).withColumnRenamed("reference", "transcript")
    return sampling.annotate(clips, fixture.lexicon(spark), normalised_already=True)


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


#: Tier allocation for the fixture's few accents.
ALLOCATION = {"A": 100, "B": 100, "C": 50}


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_sample(manifest(spark, sf_dir), tiers(spark, sf_dir), ALLOCATION, strict=False)


# --- text and entities ------------------------------------------------------------


@query
def drug_mentions(spark, sf_dir):
    clips, lex = fixture.clips(spark, sf_dir), scoring.lexicon_array(fixture.DRUGS)
    return clips.select("clip_id", F.posexplode(T.drug_mentions(F.col("reference"), lex)).alias("nth", "drug"))


@query
def dose_pairs(spark, sf_dir):
    return fixture.clips(spark, sf_dir).select("clip_id", F.explode(T.dose_pairs(F.col("reference"))).alias("d")).select("clip_id", "d.value", "d.unit")


@query
def negation_positions(spark, sf_dir):
    return fixture.clips(spark, sf_dir).select("clip_id", F.explode(T.negations(F.col("reference"))).alias("n")).select("clip_id", "n.cue", "n.idx")


@query
def entity_flags(spark, sf_dir):
    return manifest(spark, sf_dir).select("clip_id", "has_drug", "drug_terms", "has_dose", "dose_strings", "has_negation", "has_entity")


@query
def stripped_texts(spark, sf_dir):
    return merged(spark, sf_dir).select("provider", "clip_id", T.strip_spoken_punctuation(F.col("hypothesis")).alias("stripped"))


@query
def excerpts(spark, sf_dir):
    ref, hyp = T.excerpt_around(F.col("reference"), F.col("hypothesis"), F.lit(3))
    return merged(spark, sf_dir).select("provider", "clip_id", ref.alias("ref_excerpt"), hyp.alias("hyp_excerpt"))


# --- scores and summaries -----------------------------------------------------------


@query
def clip_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).drop("duration"))


@query
def wer_by_provider(spark, sf_dir):
    pairs = fixture.answers(spark, sf_dir).select("provider", S.word_error_rate(F.col("reference"), F.col("hypothesis")).alias("wer"))
    return pairs.groupBy("provider").agg(F.count("*").alias("clips"), F.round(F.avg("wer"), 9).alias("wer"))


@query
def wer_conversations(spark, sf_dir):
    """Word error rate of each turn against the turn after it, over whole conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("reference"))
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("reference").alias("hypothesis"))
    pairs = turns.join(nexts, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.size(T.words(F.col("reference"))).alias("words"), F.round(S.word_error_rate(F.col("reference"), F.col("hypothesis")), 9).alias("wer"))


@query
def headline(spark, sf_dir):
    return rounded(scoring.summarise(scored(spark, sf_dir, (*scoring.CLIP, *scoring.COSTS))))


@query
def summary_by_tier(spark, sf_dir):
    return rounded(scoring.summarise(scored(spark, sf_dir), by="tier"))


@query
def summary_by_domain(spark, sf_dir):
    return rounded(scoring.summarise(scored(spark, sf_dir), by="domain"))


@query
def summary_by_accent(spark, sf_dir):
    return rounded(scoring.summarise(scored(spark, sf_dir), by="accent"))


@query
def summary_all(spark, sf_dir):
    return rounded(scoring.summarise_all(scored(spark, sf_dir)))


@query
def cost_latency(spark, sf_dir):
    return rounded(scoring.cost_per_hour(merged(spark, sf_dir)))


@query
def significance(spark, sf_dir):
    return rounded(scoring.paired_significance(scored(spark, sf_dir)), 8)


@query
def collapse_rates(spark, sf_dir):
    return rounded(scoring.collapse_rates(scored(spark, sf_dir)))


@query
def drug_recall_intervals(spark, sf_dir):
    totals = scored(spark, sf_dir).groupBy("provider").agg(F.sum("drug_correct").alias("correct"), F.sum("drug_mentions").alias("mentions"))
    return rounded(totals.withColumn("w", stats.wilson(F.col("correct"), F.col("mentions"))).select("provider", "correct", "mentions", "w.low", "w.high"))


# --- findings and sheets --------------------------------------------------------------


@query
def findings(spark, sf_dir):
    return found(spark, sf_dir).drop("position")


@query
def findings_by_kind(spark, sf_dir):
    return found(spark, sf_dir).groupBy("provider", "kind").agg(F.count("*").alias("n"))


@query
def findings_sample(spark, sf_dir):
    return rounded(scoring.select_findings(found(spark, sf_dir))).select("provider", "clip_id", "kind", "expected", "heard", "ref_index", "weight")


@query
def review_sheet(spark, sf_dir):
    return scoring.review_sheet(scoring.select_findings(found(spark, sf_dir)), merged(spark, sf_dir))


@query
def review_cards(spark, sf_dir):
    sheet = scoring.review_sheet(scoring.select_findings(found(spark, sf_dir)), merged(spark, sf_dir))
    entry = lambda f: F.concat_ws("|", f["position"].cast("string"), f["finding_id"].cast("string"), f["kind"], f["expected"], f["heard"], f["ref_excerpt"], f["hyp_excerpt"])
    return scoring.cards(sheet).select("clip_id", "provider", "accent", "tier", "domain", F.size("findings").alias("n"), F.array_join(F.transform("findings", entry), ";").alias("findings"))


@query
def worst_failures(spark, sf_dir):
    return scoring.select_failures(scored(spark, sf_dir), 100).select("clip_id", "provider", "tier", "band", "turn", "auto_flag", F.round("wer", 9).alias("wer"))


# --- labelled sheets ----------------------------------------------------------------


def _sheet_and_findings(spark, sf_dir):
    """The review sheet and the findings that it is drawn from, each worked out once."""
    keys = written(fixture.clip_keys(spark, sf_dir), "clips")
    findings = written(found(spark, sf_dir, keys), "findings")
    sheet = written(scoring.review_sheet(scoring.select_findings(findings, kept=True), merged(spark, sf_dir, keys=keys)), "sheet")
    removed(spark, keys)
    return sheet, findings


def _sheet(spark, sf_dir):
    return _sheet_and_findings(spark, sf_dir)[0]


def _filled(sheet, turn: int = 0):
    """The sheet as a person might have filled it: judgments by the row's number, one added row in ten, some of them empty."""
    n = F.col("finding_id") + turn
    code = F.when(n % 5 == 0, "NO-ERROR").when(n % 5 == 1, "BENIGN").when(n % 7 == 2, "").otherwise(F.col("kind"))
    own = sheet.withColumns({"failure_code": code, "severity": F.concat(F.lit("S"), (F.col("finding_id") % 3 + 1).cast("string")), "note": F.when(n % 4 == 0, 'heard "twice", clearly').otherwise("")})
    blank = {"source": F.lit("human"), "kind": F.lit("HUMAN"), "expected": F.lit(""), "heard": F.lit(""), "weight": F.lit(None).cast("double"), "ref_excerpt": F.lit(""), "hyp_excerpt": F.lit(""), "auto_flag": F.lit(""), "finding_id": F.col("finding_id") + 1000}
    kept = n % 20 == 0
    added = sheet.filter(n % 10 == 0).withColumns({"failure_code": F.when(kept, "TERM-CORRUPT").otherwise(""), "severity": F.when(kept, "S2").otherwise("")}).withColumns(blank)
    return own.unionByName(added)


def _labelled(spark, sf_dir):
    """The filled sheet written as CSV, read as text, and attached to a fresh sheet."""
    path, sheet = new_path(spark, "filled-sheet"), _sheet(spark, sf_dir)
    sinks.write_csv(_filled(sheet), path)
    return labels.reattached(sheet, tables.read_sheet(spark, path, scoring.SHEET))


@query
def sheet_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("finding_id", "source", "clip_id", "provider", "kind", "weight", "failure_code", "severity", F.coalesce("note", F.lit("")).alias("note"))


@query
def taxonomy_summary(spark, sf_dir):
    return rounded(labels.taxonomy_summary(_labelled(spark, sf_dir)), 3)


@query
def label_distribution(spark, sf_dir):
    return rounded(labels.label_distribution(_labelled(spark, sf_dir)), 3)


@query
def missed_by_detector(spark, sf_dir):
    return rounded(labels.missed_rate(_labelled(spark, sf_dir)))


@query
def rater_agreement(spark, sf_dir):
    return rounded(labels.agreement(_filled(sheet := _sheet(spark, sf_dir)), _filled(sheet, turn=1).filter("source != 'human'")))


@query
def sheet_coverage(spark, sf_dir):
    return rounded(labels.coverage(*_sheet_and_findings(spark, sf_dir)))


# --- checks of scores -----------------------------------------------------------------


@query
def scores_sanity(spark, sf_dir):
    return scoring.sanity(scored(spark, sf_dir), manifest(spark, sf_dir))


@query
def accuracy_without_collapsed(spark, sf_dir):
    return rounded(scoring.accuracy_without_collapsed(scored(spark, sf_dir)))


@query
def speaker_bootstrap(spark, sf_dir):
    return rounded(scoring.speaker_bootstrap(scored(spark, sf_dir, (*scoring.CLIP, "speaker_id"))), 8)


# --- written cases: raw texts with several entities, their marks and their numbers ------------------------


def _case_pairs(spark):
    """The written cases as a cache and a manifest, merged and normalised like any other."""
    manifest = spark.createDataFrame([(c.clip_id, "x", "A", "clinical", 10.0, c.reference) for c in cases.PAIRS], "clip_id string, accent string, tier string, domain string, duration double, transcript string")
    cache = spark.createDataFrame([(c.clip_id, "p", c.hypothesis) for c in cases.PAIRS] + [("orphan", "p", "no clip")], "clip_id string, provider string, text string")
    return scoring.normalised(scoring.merge(cache, manifest)), spark.createDataFrame([(t,) for t in cases.LEXICON], "term string")


@query
def case_scores(spark, sf_dir):
    pairs, terms = _case_pairs(spark)
    return rounded(scoring.score_clips(pairs, terms, normalised_already=True).select("clip_id", *S.SCORES))


@query
def case_findings(spark, sf_dir):
    pairs, terms = _case_pairs(spark)
    return scoring.all_findings(pairs, terms, normalised_already=True).select("clip_id", "position", "kind", "expected", "heard", "ref_index")


@query
def normalised_texts(spark, sf_dir):
    raw = spark.createDataFrame([(r, ) for r, _ in cases.TEXTS], "raw string")
    return raw.select("raw", normalise(F.col("raw")).alias("normalised"))


@query
def marked_texts(spark, sf_dir):
    """Marks of judged words, their removal, excerpts around a mark, and the drugs of both sides."""
    rows = spark.createDataFrame([(k, r, h, p) for k, (r, h, p) in enumerate(cases.MARKS)], "n int, reference string, hypothesis string, positions array<int>")
    lex = scoring.lexicon_array(cases.LEXICON)
    numbered = T.marked_reference(F.col("reference"), F.col("positions"))
    diff = T.mark_diff(F.col("reference"), F.col("hypothesis"))
    out = rows.withColumns({"numbered": numbered, "diff": diff}).withColumn("plain", T.unmark(F.col("numbered")))
    evidence = T.drug_evidence(F.col("numbered"), F.col("diff.hyp"), lex)
    joined = lambda c: F.array_join(c, ",")
    return out.select("n", "numbered", "plain", F.col("diff.ref").alias("ref_marked"), F.col("diff.hyp").alias("hyp_marked"), T.excerpt(F.col("diff.ref"), 5).alias("ref_excerpt"), joined(evidence["expected"]).alias("expected"), joined(evidence["heard_known"]).alias("heard_known"))


# --- written and read again -------------------------------------------------------------------------


@query
def cache_round_trip(spark, sf_dir):
    """The cache as one JSON object an answer, in a folder for each provider, read again."""
    path = new_path(spark, "cache")
    rows = _cache(spark, sf_dir).filter("provider = 'p1'").withColumn("clip_id", F.col("clip_id").cast("string"))
    sinks.append_cache(rows, f"{path}/parquet")
    again = spark.read.parquet(f"{path}/parquet")
    again.drop("provider").repartition(4).write.json(f"{path}/json/p1")
    return spark.read.schema(tables.CACHE).json(f"{path}/json/[^_]*").withColumn("provider", F.lit("p1")).select("clip_id", "provider", "model", "text", "latency_ms", "audio_seconds", "cost_usd")


@query
def manifest_round_trip(spark, sf_dir):
    """The drawn manifest as CSV with the fixed columns, read with its schema."""
    path = new_path(spark, "manifest")
    sinks.write_manifest(drawn(spark, sf_dir).withColumnRenamed("reference", "transcript"), path)
    return tables.read_manifest(spark, path).select("clip_id", "accent", "tier", "domain", "duration", "transcript", "has_drug", "drug_terms", "has_dose", "dose_strings", "has_negation", "has_entity", "speaker_id")


@query
def lexicon_round_trip(spark, sf_dir):
    path = new_path(spark, "lexicon")
    sinks.write_lexicon(lexicon_build(spark, sf_dir), path)
    return tables.read_lexicon(spark, path)


@query
def reported_payloads(spark, sf_dir):
    """Answers as the vendors send them (JSON), and what is read out of them."""
    vendors = F.create_map(*[F.lit(x) for x in ("p0", "groq", "p1", "deepgram", "p2", "assemblyai", "p3", "google", "p4", "groq")])
    rows = _cache(spark, sf_dir).withColumn("vendor", F.element_at(vendors, F.col("provider")))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("text").alias("transcript"))).alias("alternatives"))).alias("channels")).alias("results")))
    google = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content"))).alias("candidates")))
    plain = F.to_json(F.struct("text", F.col("latency_ms").alias("took")))
    rows = rows.withColumn("payload", F.when(F.col("vendor") == "deepgram", deep).when(F.col("vendor") == "google", google).otherwise(plain))
    latency = ingest.latency_ms(F.col("payload"), "$.took", F.col("latency_ms") + 0.4)
    return rows.select("provider", "clip_id", ingest.reported_text(F.col("payload"), F.col("vendor")).alias("text"), latency.alias("latency_ms"))


# --- sampling ---------------------------------------------------------------------------


@query
def accent_tiers(spark, sf_dir):
    return tiers(spark, sf_dir)


@query
def stratified_draw(spark, sf_dir):
    return drawn(spark, sf_dir).select("clip_id", "tier", "accent", "domain", "has_entity")


@query
def quota_checks(spark, sf_dir):
    return rounded(sampling.check_quotas(manifest(spark, sf_dir).join(tiers(spark, sf_dir), "accent"), ALLOCATION))


@query
def sample_sheet(spark, sf_dir):
    return rounded(sampling.sample_sheet(drawn(spark, sf_dir)))


# --- integrity -----------------------------------------------------------------------------


@query
def duplicate_pairings(spark, sf_dir):
    clips = fixture.clips(spark, sf_dir)
    rows = clips.select("clip_id", "speaker_id", F.col("reference").alias("transcript"), F.concat(F.lit("/"), F.col("accent"), F.lit("/"), F.col("drug"), F.lit("/"), F.col("clip_id").cast("string"), F.lit(".wav")).alias("path"))
    return integrity.duplicate_pairings(rows).select("verdict", "shape", "subject", "clips", F.array_join(F.transform("clip_ids", lambda c: c.cast("string")), ",").alias("clip_ids"))


@query
def speech_rate_outliers(spark, sf_dir):
    clips = fixture.clips(spark, sf_dir).withColumnRenamed("reference", "transcript")
    reason = integrity.speech_rate_reason(F.col("transcript"), F.col("duration"), F.col("low"), F.col("high"))
    bounds = integrity.speech_rate_bounds(clips)  # one row
    return rounded(clips.join(F.broadcast(bounds)).select("clip_id", "duration", "low", "high", reason.alias("reason")).filter("reason is not null"))


@query
def repeated_line_items(spark, sf_dir):
    """Raw line items as a manifest whose rows share audio: the shape of an indexing bug."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = lines.select(F.col("l_partkey").alias("clip_id"), F.col("l_suppkey").alias("speaker_id"), F.lit("").alias("transcript"), key.alias("path"))
    out = integrity.duplicate_pairings(rows).filter("shape = 'rows share audio'")
    return out.select("verdict", "subject", "clips", F.array_join(F.transform("clip_ids", lambda c: c.cast("string")), ",").alias("clip_ids"))


# --- lexicon ------------------------------------------------------------------------------------


def _records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.concat("p_name", F.lit(" and "), F.lower("p_type")).alias("generic_name"), F.col("p_brand").alias("brand_name"), F.array(F.struct(F.lower("p_name").alias("name"))).alias("active_ingredients"))


@query
def lexicon_components(spark, sf_dir):
    terms = lexicon.terms_of_records(_records(spark, sf_dir)).filter("kind = 'generic'")
    return lexicon.component_terms(terms)


@query
def lexicon_build(spark, sf_dir):
    return lexicon.build(_records(spark, sf_dir), fixture.lexicon(spark), spark.createDataFrame([("steel",), ("copper",)], "term string"))


# --- ingest --------------------------------------------------------------------------------------


def _cache(spark, sf_dir):
    rows = fixture.answers(spark, sf_dir).select("clip_id", "provider", F.lit("m").alias("model"), F.col("hypothesis").alias("text"), "latency_ms", "audio_seconds", "cost_usd")
    return rows.filter(~((F.col("provider") == "p2") & (F.col("clip_id") % 7 == 0)))  # an answer that is still missing


@query
def pending_clips(spark, sf_dir):
    return ingest.pending(fixture.clips(spark, sf_dir), _cache(spark, sf_dir), "p2").select("clip_id", "duration")


@query
def spend_cap(spark, sf_dir):
    calls = _cache(spark, sf_dir).withColumn("list_cost", ingest.list_cost(F.col("audio_seconds"), F.lit(0.0077)))
    return rounded(ingest.within_cap(calls, cap=1.0).select("provider", "clip_id", "spent", "allowed"), 6)


@query
def run_summary(spark, sf_dir):
    return rounded(ingest.run_summary(_cache(spark, sf_dir)), 6)


@query
def projected_cost(spark, sf_dir):
    return rounded(ingest.projected_cost(fixture.clips(spark, sf_dir), ingest.providers(spark)), 6)


@query
def cache_gates(spark, sf_dir):
    """By provider: answers, models, answers in other than ASCII, and whether the cache is complete enough."""
    return ingest.cache_gates(_cache(spark, sf_dir), fixture.clips(spark, sf_dir))


@query
def clips_per_speaker(spark, sf_dir):
    per = fixture.clips(spark, sf_dir).groupBy("speaker_id").agg(F.count("*").alias("clips"))
    return per.groupBy("clips").agg(F.count("*").alias("speakers"))


# --- archives, pages, secrets ------------------------------------------------------------------------


@query
def member_key_join(spark, sf_dir):
    """Pages joined to themselves by the last two parts of their address, as archive members are to a manifest."""
    pages = table(spark, sf_dir, "pages")
    keys = members_wanted(pages.select(F.col("url").alias("path"), F.col("page_id").alias("clip_id")))
    return keys.join(pages.select("page_id", T.member_key(F.col("url")).alias("key")), "key").groupBy("key").agg(F.count("*").alias("pairs"), F.min("page_id").alias("first_page"))


SECRET = r"(?i)(sk-[a-z0-9]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(api[_-]?key|secret|token|password)\s*[=:]\s*[\"']?[A-Za-z0-9/+_-]{16,})"


@query
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(SECRET)).select("doc_id", "source")
