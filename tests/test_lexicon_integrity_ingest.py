import json

import pytest
from pyspark.sql import functions as F

from tessalith.operators import ingest as ig
from tessalith.operators import integrity as it
from tessalith.operators import lexicon as lx
from tessalith.schemas import CACHE, DRUG_RECORD


def terms(df):
    return sorted(r.term for r in df.collect())


# --- lexicon ---


def test_records_and_missing_fields(spark):
    rows = [("Warfarin Sodium; Zinc and X", "Coumadin", [("WARFARIN",), (None,)]), (None, None, None), ("insulin glargine", None, [])]
    found = lx.terms_of_records(spark.createDataFrame(rows, DRUG_RECORD))
    assert terms(found.filter("kind = 'generic'")) == ["insulin glargine", "warfarin", "warfarin sodium", "x", "zinc"]
    assert terms(found.filter("kind = 'brand'")) == ["coumadin"]


def test_components_are_filtered_hard(spark):
    generic = spark.createDataFrame([("insulin glargine",), ("warfarin sodium",), ("tc99m sestamibi",), ("extended release xyz",), ("solo",)], "term string")
    english = spark.createDataFrame([("insulin",), ("release",)], "term string")
    assert terms(lx.component_terms(generic, english)) == ["extended", "glargine", "sestamibi", "warfarin"]


def test_clean_terms(spark):
    some = spark.createDataFrame([(t,) for t in ("abc", "12345", "Sodium", "warfarin sodium", " Pain ", "pain relief", "carbon dioxide", "zoloft")], "term string")
    brands = spark.createDataFrame([("pain",), ("pain relief",)], "term string")
    english = spark.createDataFrame([("pain",), ("pain relief",), ("zoloft",)], "term string")
    assert terms(lx.clean_terms(some, brands, english)) == ["pain relief", "warfarin sodium", "zoloft"]
    assert "pain" in terms(lx.clean_terms(some))


def test_build_trusts_names_over_brands(spark):
    records = spark.createDataFrame([("insulin glargine", "Relief", [("glargine",)]), ("quinine", "Insulin", None)], DRUG_RECORD)
    names = spark.createDataFrame([("insulin",)], "term string")
    english = spark.createDataFrame([("insulin",), ("relief",)], "term string")
    assert terms(lx.build(records, names, english)) == ["glargine", "insulin", "insulin glargine", "quinine"]


# --- integrity ---

ROWS = "clip_id string, transcript string, speaker_id string, path string, duration double"


def test_rate_bounds(spark):
    frame = spark.createDataFrame([(str(k), "w " * 20, "s", "p", 10.0) for k in range(5)], ROWS)
    assert tuple(it.speech_rate_bounds(frame).first()) == (0.5, 8.0)
    assert tuple(it.speech_rate_bounds(frame.limit(0)).first()) == pytest.approx((1.67 * 0.25, 1.67 * 4))
    reason = it.speech_rate_reason(F.col("transcript"), F.col("duration"), F.lit(0.5), F.lit(8.0))
    got = [r[0] for r in spark.createDataFrame([("1", "w " * 20, "", "", 10.0), ("2", "w " * 90, "", "", 10.0), ("3", "w", "", "", 0.0), ("4", None, "", "", 4.0)], ROWS).orderBy("clip_id").select(reason).collect()]
    assert got[0] is None and got[1].startswith("9.00 words per second (90 words in 10.0s)") and got[2].startswith("zero duration") and got[3].startswith("0.00 words")


def test_pairings(spark):
    rows = [("1", "same", "a", "p1", 1.0), ("2", "same ", "b", "p2", 1.0), ("3", "twice", "c", "p3", 1.0), ("4", "twice", "c", "p4", 1.0), ("5", "own", "d", "p5", 1.0), ("6", "other", "e", "p5", 1.0)]
    out = {(r.verdict, r["shape"]): list(r.clip_ids) for r in it.duplicate_pairings(spark.createDataFrame(rows, ROWS)).collect()}
    assert out == {("expected", "same prompt, other speakers"): ["1", "2"], ("suspicious", "one speaker, same transcript"): ["3", "4"], ("suspicious", "rows share audio"): ["5", "6"]}


def test_spot_check_and_halt(spark):
    frame = spark.createDataFrame([(f"c{k}", "w " * 20, f"s{k}", f"p{k}", 10.0) for k in range(30)], ROWS)
    audio = spark.createDataFrame([(f"c{k}", 10.0 if k else 30.0, 0.2 if k != 1 else 0.0, None if k != 2 else "broken") for k in range(29)], "clip_id string, seconds double, rms double, error string")
    flagged = {r.clip_id: r.reasons for r in it.spot_check(frame, audio, None).collect()}
    assert set(flagged) == {"c0", "c1", "c2", "c29"} and flagged["c29"] == ["missing audio file"] and flagged["c2"] == ["unreadable audio: broken"]
    assert flagged["c0"][0].startswith("duration 30.0s") and flagged["c1"][0].startswith("silent: RMS")
    assert it.spot_check_sample(frame).count() == 20 and sorted(map(str, it.spot_check_sample(frame).collect())) == sorted(map(str, it.spot_check_sample(frame.repartition(4)).collect()))
    assert it.should_halt(3, 0) and it.should_halt(0, 1) and not it.should_halt(2, 0)
    result = it.outcome(frame, audio)
    assert result["checked"] == 20 and result["expected"] == 1 and result["suspicious"] == 0


# --- ingest ---


def manifest(spark, n=3):
    return spark.createDataFrame([(f"c{k}", 10.0 * (k + 1)) for k in range(n)], "clip_id string, duration double")


def answer(clip):
    return {"text": f"text of {clip['clip_id']}", "latency_ms": 123, "cost_usd": 0.01}


def test_backoff_and_status():
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ig.Transient
        return {"text": "x"}

    assert ig.with_backoff(flaky, sleep=slept.append) == {"text": "x"} and slept == [1, 2]
    assert ig.with_backoff(lambda: ig.classify(404), sleep=slept.append) is None and len(slept) == 2
    assert ig.with_backoff(lambda: ig.classify(503), tries=3, sleep=slept.append) is None and slept[2:] == [1, 2]
    ig.classify(200)


def test_run_stores_answers_and_resumes(spark):
    stored, failing = [], {"c1"}
    cache = lambda: spark.createDataFrame([tuple(r.values()) for r in stored], CACHE)

    def transcribe(provider):
        def call(clip):
            if clip["clip_id"] in failing:
                raise ig.Permanent
            return answer(clip)

        return call

    catalogue = (("p", "v", "m", "K", 0.0, True),)
    (first,) = ig.run_all(manifest(spark), cache, stored.append, transcribe, catalogue, sleep=lambda _: None)
    assert (first.clips_ok, first.clips_failed) == (2, 1) and {r["clip_id"] for r in stored} == {"c0", "c2"}
    failing.clear()
    (second,) = ig.run_all(manifest(spark), cache, stored.append, transcribe, catalogue)
    assert (second.clips_ok, second.cost_usd) == (1, 0.01) and ig.pending(manifest(spark), cache(), "p").count() == 0
    summary = ig.run_summary(cache()).first()
    assert (summary.clips_ok, summary.cost_usd, summary.median_latency_ms) == (3, 0.03, 123)


def test_cap_stops_before_the_call_that_breaches_it():
    stored = []
    clips = [{"clip_id": f"c{k}", "duration": 60.0} for k in range(5)]
    out = ig.run_provider("p", "m", 0.5, clips, lambda c: {"text": "x", "cost_usd": 1.0}, stored.append, cap=2.5)
    assert out.stopped_on_cap and out.clips_ok == len(stored) == 2 and out.cost_usd == 2.0
    assert ig.run_provider("p", "m", 3.0, clips, lambda c: {"text": "x"}, stored.append, cap=2.5).clips_ok == 0


@pytest.mark.parametrize("key", ["long", "string"])
def test_within_cap_matches_a_loop(spark, key):
    rows = [(k if key == "long" else f"clip{k:03d}", f"p{k % 2}", 0.01 * (k % 7), 0.05) for k in range(200)]
    df = spark.createDataFrame(rows, f"clip_id {key}, provider string, cost_usd double, list_cost double")
    got = {(r.provider, r.clip_id): (r.spent, r.allowed) for r in ig.within_cap(df, 1.0).collect()}
    for p in ("p0", "p1"):
        spent, n, stopped = 0.0, 0, False
        for k, provider, cost, price in rows:
            if provider == p:
                stopped = stopped or spent + (spent / n if n else price) > 1.0 + 1e-12
                assert got[p, k] == (pytest.approx(spent), not stopped)
                if not stopped:
                    spent, n = round(spent + cost, 10), n + 1


def test_the_cap_ends_a_run_for_good(spark):
    rows = [("a", "p", 0.5, 0.1), ("b", "p", 0.0, 0.1), ("c", "p", 0.0, 0.1), ("d", "p", 0.0, 0.1), ("a", "q", 0.0, 2.0), ("b", "q", 0.0, 0.1)]
    df = spark.createDataFrame(rows, "clip_id string, provider string, cost_usd double, list_cost double")
    got = sorted((r.provider, r.clip_id, r.spent, r.allowed) for r in ig.within_cap(df, 0.9).collect())
    assert got == [("p", "a", 0.0, True), ("p", "b", 0.5, False), ("p", "c", 0.5, False), ("p", "d", 0.5, False), ("q", "a", 0.0, False), ("q", "b", 0.0, False)]


def test_costs_numbers_and_payloads(spark):
    usd = {r.provider: r.usd for r in ig.projected_cost(manifest(spark), ig.providers(spark)).collect()}
    assert usd["dg-general"] == pytest.approx(0.0077) and usd["whisper"] == 0
    body = json.dumps({"text": "hi", "d": "2.5", "bad": "x", "neg": -1, "results": {"channels": [{"alternatives": [{"transcript": "deep"}]}]}, "candidates": [{"content": {"parts": [{"text": "gem"}]}}]})
    df = spark.createDataFrame([(body, v) for v in ("groq", "deepgram", "google", "other")], "b string, v string")
    assert [r[0] for r in df.select(ig.reported_text(F.col("b"), F.col("v"))).collect()] == ["hi", "deep", "gem", None]
    assert [tuple(r) for r in df.limit(1).select(*[ig.reported_number(F.col("b"), f"$.{k}") for k in ("d", "bad", "neg", "none")]).collect()] == [(2.5, None, None, None)]


def test_transcribe_all(spark):
    def call(clip):
        if clip["clip_id"] == "c1":
            raise ig.Permanent
        return answer(clip)

    out = ig.transcribe_all(manifest(spark), "p", "m", call).collect()
    assert sorted(r.text for r in out) == ["text of c0", "text of c2"]
