import json

import pytest
from pyspark.sql import functions as F

from tessalith.operators import sampling as sp

CLIP = "clip_id string, accent string, domain string, duration double, has_entity boolean, has_drug boolean, has_dose boolean, has_negation boolean, transcript string"


def clips(spark, accents, entity=60, plain=60, duration=10.0):
    rows = []
    for a in accents:
        for d in ("clinical", "general"):
            rows += [(f"{a}-{d}-{k}{'-ent' if k < entity else ''}", a, d, duration, k < entity, False, False, k < entity, "x") for k in range(entity + plain)]
    return spark.createDataFrame(rows, CLIP)


def tiers(spark, of):
    return spark.createDataFrame(list(of.items()), "accent string, tier string")


def test_tiers_by_rank_then_name(spark):
    rows = [(f"a{k:02d}", 1000 - k // 2, 20) for k in range(30)] + [("all", 10**6, 99), ("gone", 5000, None), ("thin", 1, 3), ("late", 2, 15)]
    out = {r.accent: r.tier for r in sp.accent_tiers(spark.createDataFrame(rows, "accent string, num_clips long, in_split long")).collect()}
    assert [out[f"a{k:02d}"] for k in (0, 4, 5, 24, 25)] == ["A", "A", "B", "B", "C"] and out["late"] == "C"
    assert not {"all", "gone", "thin"} & set(out)


def test_stats_from_json(spark):
    text = json.dumps({"all": {"num_clips": 9}, "yoruba": {"num_clips": 7, "test": {"num_clips": 3}}, "igbo": {"num_clips": 2, "train": {"num_clips": 2}}, "odd": 5})
    out = {r.accent: (r.num_clips, r.in_split) for r in sp.stats_from_json(spark.createDataFrame([(text,)], "value string"), "test").collect()}
    assert out == {"all": (9, None), "yoruba": (7, 3), "igbo": (2, None)}


def test_annotate(spark):
    rows = [("1", "Takes Metformin 500 mg, denies pain."), ("2", "all is well"), ("3", "five hundred mg of warfarin")]
    lexicon = spark.createDataFrame([("metformin",), ("warfarin",)], "term string")
    out = {r.clip_id: r for r in sp.annotate(spark.createDataFrame(rows, "clip_id string, transcript string"), lexicon).collect()}
    assert (out["1"].drug_terms, out["1"].dose_strings, out["1"].has_negation) == ("metformin", "500.0 mg", True)
    assert not out["2"].has_entity and out["2"].drug_terms == "" and out["3"].dose_strings == "500.0 mg"


ACCENTS = {f"a{k}": "A" for k in range(5)} | {f"b{k}": "B" for k in range(6)}


def test_draw_deals_in_turn_under_the_cap(spark):
    frame = clips(spark, ACCENTS)
    got = sp.draw_sample(frame, tiers(spark, ACCENTS), {"A": 100, "B": 60}, cap=22).collect()
    assert len(got) == 160 and sum(r.tier == "A" for r in got) == 100
    for tier, n in (("A", 100), ("B", 60)):
        own = [r for r in got if r.tier == tier]
        assert sum(r.domain == "clinical" for r in own) == round(n * 0.8)
        per = [sum(r.accent == a for r in own) for a, t in ACCENTS.items() if t == tier]
        assert max(per) <= 22 and max(per) - min(per) <= 2
    assert all(r.has_entity for r in got)
    assert sorted(map(str, got)) == sorted(map(str, sp.draw_sample(frame.repartition(5), tiers(spark, ACCENTS), {"A": 100, "B": 60}, cap=22).collect()))


def test_a_short_tier_is_an_error(spark):
    with pytest.raises(ValueError, match="tier A: 40 of 100"):
        sp.draw_sample(clips(spark, ["a0"]), tiers(spark, {"a0": "A"}), {"A": 100}, cap=40)
    assert sp.draw_sample(clips(spark, ["a0"], duration=31.0), tiers(spark, {"a0": "A"}), {"A": 5}, strict=False).count() == 0


def test_quotas(spark):
    four = {f"a{k}": "A" for k in range(4)}
    rows = [(f"{a}{d}{k}", a, d, 10.0, True, False, False, True, "x") for a in four for d, n in (("clinical", 24), ("general", 6)) for k in range(n)]
    good = spark.createDataFrame(rows, CLIP).withColumn("tier", F.lit("A"))
    assert sp.check_quotas(good, {"A": 120}).collect() == []
    bad = good.filter("accent != 'a0'").withColumn("duration", F.when(F.col("accent") == "a1", 40.0).otherwise(F.col("duration"))).withColumn("has_entity", F.col("accent") == "a2")
    broken = {(r.rule, r.subject): r.found for r in sp.check_quotas(bad.unionByName(bad.limit(1)), {"A": 120, "B": 5}, cap=20).collect()}
    assert {k for k, _ in broken} == {"size", "tier count", "accents in tier", "accent cap", "entity share", "duration", "unique clip_id"}
    assert broken["tier count", "B"] == 0 and broken["accents in tier", "A"] == 3 and broken["duration", None] >= 30
    assert {r.rule for r in sp.check_quotas(good.withColumn("domain", F.lit("clinical")), {"A": 120}).collect()} == {"clinical share"}


def test_sample_sheet(spark):
    frame = clips(spark, ["a0", "a1"], 2, 2).withColumn("tier", F.lit("A"))
    rows = sp.sample_sheet(frame).collect()
    assert {r.breakdown: sum(x.clips for x in rows if x.breakdown == r.breakdown) for r in rows} == dict.fromkeys(("all", "tier", "domain", "accent"), 16)
    assert all(r.has_entity_share == 0.5 for r in rows)
