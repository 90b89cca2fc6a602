import random

import pytest
from pyspark.sql import functions as F

from tessalith.functions import scores as S
from tessalith.functions import stats
from tessalith.operators import scoring as sc

DRUGS = ("metformin", "metronidazole", "warfarin", "amoxicillin", "trimethoprim", "pyrimethamine", "propranolol", "morphine", "hydralazine", "hydroxyzine")


@pytest.fixture(scope="module")
def score(spark):
    lexicon = spark.createDataFrame([(d,) for d in DRUGS], "term string")

    def scored(*pairs):
        rows = [(f"c{k}", "p", "x", "A", "clinical", 10.0, r, h) for k, (r, h) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "clip_id string, provider string, accent string, tier string, domain string, duration double, reference string, hypothesis string")
        out = sc.score_clips(df, lexicon, normalised_already=True).orderBy("clip_id").collect()
        return out if len(pairs) > 1 else out[0]

    return scored


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_word_error_rate_matches_brute_force(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12)))) for _ in range(150)]
    pairs += [(" ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(5, 420))), ("é 日本", "e 日本"), ("a", None)]
    got = spark.createDataFrame(pairs, "r string, h string").select(S.word_error_rate(F.col("r"), F.col("h"))).collect()
    want = [None if not r.split() else levenshtein(r.split(), (h or "").split()) / len(r.split()) for r, h in pairs]
    assert [g[0] for g in got] == pytest.approx(want)


@pytest.mark.parametrize(("ref", "hyp", "wer", "stripped"), [
    ("the patient is stable", "the patient is stable", 0.0, 0.0), ("the patient is stable", "the patient is very stable", 0.25, 0.25), ("the patient is stable", "", 1.0, 1.0),
    ("", "anything", None, None), ("no fever no cough", "no fever comma no cough", 0.25, 0.0), ("comma", "comma", 0.0, None),
])
def test_wer_cases(score, ref, hyp, wer, stripped):
    r = score((ref, hyp))
    assert (r.wer, r.wer_spoken_punct_removed) == (wer, stripped)


@pytest.mark.parametrize(("ref", "hyp", "want"), [
    ("takes metformin daily", "takes metformin daily", (1, 1, 0, 0, 0)), ("takes metformin", "takes metformim", (1, 1, 0, 0, 0)), ("takes metformin daily", "takes metronidazole daily", (1, 0, 1, 0, 1)),
    ("takes metformin daily", "takes it daily", (1, 0, 0, 1, 0)), ("warfarin and metformin", "warfarin and metronidazole", (2, 1, 1, 0, 1)),
    ("trimethoprim with pyrimethamine", "trimethropium with pyrimethamine", (2, 1, 0, 1, 0)), ("takes warfarin today", "warfarin and warfarin", (1, 1, 0, 0, 1)),
    ("give propanolol now", "give propranolol now", (0, 0, 0, 0, 0)), ("more follicles seen", "morphine calls seen", (0, 0, 0, 0, 1)), ("patient stable", "takes warfarin", (0, 0, 0, 0, 1)),
    ("warfarin warfarin", "warfarim warfarin", (2, 2, 0, 0, 0)),
])
def test_drug_cases(score, ref, hyp, want):
    r = score((ref, hyp))
    assert (r.drug_mentions, r.drug_correct, r.drug_substitution, r.drug_deletion, r.drug_false_positive) == want


@pytest.mark.parametrize(("ref", "hyp", "want"), [
    ("take 500 mg twice", "take 500 mg twice", (1, 1, 0, 0, 0)), ("take 500 mg", "take 50 mg", (1, 0, 1, 0, 0)), ("take 500 mg", "take 500 mcg", (1, 0, 0, 1, 0)), ("take 500 mg", "take some", (1, 0, 0, 0, 1)),
    ("5 mg and 5 mg", "5 mg", (2, 1, 0, 0, 1)), ("5 mg and 10 mg", "10 mg and 5 mcg", (2, 0, 1, 0, 1)), ("10 cc", "10 ml", (1, 1, 0, 0, 0)),
])
def test_dose_cases(score, ref, hyp, want):
    r = score((ref, hyp))
    assert (r.doses, r.dose_correct, r.dose_value_error, r.dose_unit_error, r.dose_missing) == want


@pytest.mark.parametrize(("ref", "hyp", "want"), [
    ("denies chest pain", "denies chest pain", (1, 1)), ("denies chest pain", "reports chest pain", (1, 0)), ("negative for malaria today", "negative for malaria today", (1, 1)),
    ("no fever but a cough is present in this patient today", "fever but a cough is present in this patient no", (1, 0)),
])
def test_negation_cases(score, ref, hyp, want):
    r = score((ref, hyp))
    assert (r.negation_cues, r.negation_preserved) == want and r.negation_lost == want[0] - want[1]


def test_a_large_lexicon_is_joined_with_the_same_result(spark, score, monkeypatch):
    pairs = [("takes metformin daily", "takes metronidazole daily"), ("warfarin and warfarin", "warfarin"), ("", "morphine"), ("no drug", None)]
    few = score(*pairs)
    monkeypatch.setattr(sc, "LITERAL_TERMS", 2)
    assert score(*pairs) == few


# Ten clips with four planted errors.
CASES = [
    ("clean1", "A", "the patient takes metformin 500 mg daily", None), ("clean2", "A", "denies chest pain and shortness of breath", None), ("clean3", "A", "give 10 ml of the suspension", None),
    ("clean4", "B", "the patient takes warfarin 5 mg nightly", None), ("clean5", "B", "no fever and no cough on examination", None), ("clean6", "C", "amoxicillin 250 mg three times daily", None),
    ("drugsub", "C", "the patient takes metformin 500 mg daily", "the patient takes metronidazole 500 mg daily"), ("doseval", "C", "the patient takes warfarin 5 mg nightly", "the patient takes warfarin 50 mg nightly"),
    ("doseunit", "B", "give 10 ml of the suspension", "give 10 mg of the suspension"), ("negdrop", "A", "denies chest pain and shortness of breath", "reports chest pain and shortness of breath"),
]


@pytest.fixture(scope="module")
def planted(spark):
    cache = spark.createDataFrame([(c, "testprov", "m", h or r, 500.0, 10.0, 0.001) for c, _, r, h in CASES] + [("orphan", "testprov", "m", "x", 1.0, 1.0, 1.0)], "clip_id string, provider string, model string, text string, latency_ms double, audio_seconds double, cost_usd double")
    manifest = spark.createDataFrame([(c, "yoruba", t, "clinical", 10.0, r) for c, t, r, _ in CASES], "clip_id string, accent string, tier string, domain string, duration double, transcript string")
    merged = sc.merge(cache, manifest).cache()
    lexicon = spark.createDataFrame([(d,) for d in DRUGS[:4]], "term string")
    return merged, sc.score_clips(merged, lexicon).cache(), lexicon


def test_end_to_end_headline(planted):
    merged, scored, _ = planted
    row = sc.summarise(scored, merged).first()
    assert (row.clips, row.drug_mentions, row.drug_accuracy, row.drug_substitutions) == (10, 5, pytest.approx(0.8), 1)
    assert (row.doses, row.dose_value_accuracy, row.dose_value_errors, row.dose_unit_errors) == (8, pytest.approx(7 / 8), 1, 1)
    assert row.negation_cues == 4 and row.negation_preservation == pytest.approx(3 / 4)
    assert row.cost_per_audio_hour == pytest.approx(0.36) and row.median_latency_ms == 500
    tiers = sc.summarise(scored, by="tier").collect()
    assert {r.tier for r in tiers} == {"A", "B", "C"} and sum(r.drug_substitutions for r in tiers) == 1
    every = sc.summarise_all(scored).collect()
    assert sorted({r.breakdown for r in every}) == ["accent", "all", "domain", "tier"] and all(sum(r.clips for r in every if r.breakdown == b) == 10 for b in ("accent", "all", "domain", "tier"))
    assert sorted(r.clip_id for r in scored.collect() if r.wer == 0) == [f"clean{k}" for k in range(1, 7)]


def test_failure_sheet_puts_priorities_first(planted):
    rows = sc.select_failures(planted[1], 4).collect()
    assert [r.clip_id for r in rows] == ["drugsub", "doseval", "negdrop", "doseunit"]
    assert [r.auto_flag for r in rows] == ["DRUG-SUB candidate", "DOSE-VAL candidate", "NEG-FLIP candidate", "high WER"]


def test_findings_are_the_planted_errors(planted, spark):
    merged, scored, lexicon = planted
    rows = {(r.clip_id, r.kind, r.expected, r.heard, r.ref_index) for r in sc.all_findings(merged, lexicon).collect()}
    assert rows == {("drugsub", "DRUG-SUB", "metformin", "metronidazole", 3), ("doseval", "DOSE-VAL", "5 mg", "50 mg", 4), ("doseunit", "DOSE-UNIT", "10 ml", "10 mg", 1), ("negdrop", "NEG-FLIP", "denies", "", 0)}
    sheet = sc.review_sheet(sc.select_findings(sc.all_findings(merged, lexicon)), sc.normalised(merged))
    assert tuple(sheet.columns) == sc.SHEET and {r.failure_code + r.severity + r.note for r in sheet.collect()} == {""}
    cards = sc.cards(sheet).collect()
    assert sum(len(c.findings) for c in cards) == 4 and all(f.position == 1 for c in cards for f in c.findings)


def test_collapsed_transcripts_are_one_finding(spark):
    df = spark.createDataFrame([("no fever 5 mg warfarin today", "something else was heard here instead")], "r string, h string")
    (f,) = df.select(S.findings_of(F.col("r"), F.col("h"), sc.lexicon_array(DRUGS))).first()[0]
    assert (f.kind, f.expected, f.ref_index) == ("ASR-COLLAPSE", "no fever 5 mg warfarin today", 0)


def test_findings_come_in_reading_order(spark):
    df = spark.createDataFrame([("no fever so take 5 mg of warfarin and call back soon my friend", "fever so take 7 mg of wine and call back soon my friend")], "r string, h string")
    got = df.select(S.findings_of(F.col("r"), F.col("h"), sc.lexicon_array(DRUGS))).first()[0]
    assert [(f.kind, f.ref_index) for f in got] == [("NEG-FLIP", 0), ("DOSE-VAL", 4), ("DRUG-DEL", 7)]
    assert {f.kind for f in got} <= set(S.KINDS)


@pytest.mark.parametrize("sent", [0, sc.SENT_BYTES])
@pytest.mark.parametrize("terms", [1, sc.LITERAL_TERMS])
def test_repeated_texts_are_judged_once_with_the_same_findings(spark, monkeypatch, sent, terms):
    monkeypatch.setattr(sc, "SENT_BYTES", sent)
    monkeypatch.setattr(sc, "LITERAL_TERMS", terms)
    rng = random.Random(7)
    words = "aspirin codeine 5 50 mg ml no denies pain daily comma".split()
    texts = [None, "", "no", *(" ".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(12))]
    rows = [(f"c{n}", f"p{n % 3}", "x", "A", "d", 1.0, rng.choice(texts), rng.choice(texts)) for n in range(300)]
    merged = spark.createDataFrame(rows, "clip_id string, provider string, accent string, tier string, domain string, duration double, reference string, hypothesis string")
    lexicon = spark.createDataFrame([("aspirin",), ("codeine",)], "term string")
    want = sc.all_findings(merged, lexicon, normalised_already=True)
    got = sc.all_findings(merged, lexicon, normalised_already=True, repeated=True)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


@pytest.mark.parametrize("target", [120, 150, 4, 1000])
def test_weights_sum_to_the_population(spark, target):
    totals = {"DRUG-SUB": 5, "DRUG-DEL": 163, "DOSE-MISS": 92, "NEG-FLIP": 38}
    rows = [(f"c{k}", "p", "x", "A", "clinical", kind, "e", "h", k, 0) for kind, n in totals.items() for k in range(n)]
    df = spark.createDataFrame(rows, "clip_id string, provider string, accent string, tier string, domain string, kind string, expected string, heard string, ref_index int, position int")
    out = sc.select_findings(df, target).collect()
    assert len(out) == min(target, sum(totals.values()))
    for kind, n in totals.items():
        assert sum(r.weight for r in out if r.kind == kind) == pytest.approx(n)
    if target == 120:
        assert {k: sum(r.kind == k for r in out) for k in totals} == {"DRUG-SUB": 5, "DRUG-DEL": 55, "DOSE-MISS": 30, "NEG-FLIP": 30}
    assert sorted(map(str, out)) == sorted(map(str, sc.select_findings(df.repartition(7), target).collect()))
    assert sc.select_findings(df.limit(0), target).columns[-1] == "weight"


# Counts of disagreement with statistic, p-value and test.
MCNEMAR = [(2, 8, 2.5, 0.109375, "exact"), (20, 5, 7.84, 0.005110260660855, "chi2"), (0, 0, 0.0, 1.0, "exact"), (31, 2, 23.757575757575758, 1.0926445169555457e-06, "chi2"), (19, 2, 12.19047619047619, 0.00022125244140625, "exact"), (45, 1, 40.19565217391305, 2.2975902603763334e-10, "chi2"), (15, 15, 0.0, 1.0, "chi2"), (20, 8, 4.321428571428571, 0.0376353137873143, "chi2")]


@pytest.mark.parametrize(("a", "b", "statistic", "p", "test"), MCNEMAR)
def test_mcnemar(spark, a, b, statistic, p, test):
    m = spark.createDataFrame([(a, b)], "a long, b long").select(stats.mcnemar(F.col("a"), F.col("b")).alias("m")).first().m
    assert (m.discordant, m.test) == (a + b, test) and m.statistic == pytest.approx(statistic) and m.p_value == pytest.approx(p, rel=1e-9)


def test_complementary_error(spark):
    import math

    zs = [0.0, 0.1, 1.0, 2.49, 2.5, 3.0, 5.0, 10.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(stats.complementary_error(F.col("z"))).collect()
    assert [g[0] for g in got] == pytest.approx([math.erfc(z) for z in zs], rel=1e-9)


def test_paired_significance(spark):
    def row(p, k, ok):
        return (p, f"c{k}", 1, int(ok), 0, 0, 0, 0, 0)

    rows = [row("a", k, True) for k in range(4)] + [row("b", k, k == 0) for k in range(4)] + [row("a", 9, True), ("b", "c9", 0, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "provider string, clip_id string, drug_mentions int, drug_correct int, doses int, dose_correct int, dose_unit_error int, negation_cues int, negation_preserved int")
    (r,) = sc.paired_significance(df).collect()
    assert (r.metric, r.provider_a, r.provider_b, r.n_pairs, r.a_only, r.b_only, r.a_clips_correct, r.b_clips_correct) == ("drug", "a", "b", 4, 3, 0, 4, 1)
    with pytest.raises(ValueError, match="binary"):
        sc.paired_significance(df, ("wer",))


def test_null_groups_and_empty_denominators(spark):
    rows = [("p", None, 0.5, None, *[0] * 14), ("p", "A", None, None, *[0] * 14)]
    df = spark.createDataFrame(rows, f"provider string, tier string, {', '.join(f'{c} double' for c in S.SCORES[:2])}, {', '.join(f'{c} int' for c in S.SCORES[2:])}")
    out = {r.tier: r for r in sc.summarise(df, by="tier").collect()}
    assert out[None].clips == 1 and out[None].wer == 0.5 and out["A"].wer is None and out["A"].drug_accuracy is None and out["A"].drug_f1 is None
