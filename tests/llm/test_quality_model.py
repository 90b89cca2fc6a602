import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessalith.llm import learning, quality_model as qm
from tessalith.llm.kernel import Text

CLEAN = "the cat sat on the mat and the dog ran to the park with a red ball"


def test_contexts_match_brute_force(spark, documents):
    texts = ["a b c a", "x", None, "", "a b !! b", "a b c a"]
    got = qm.corpus_contexts(documents(texts).repartition(3))
    places, signs = qm.index_vectors()
    want = np.zeros((qm.BUCKETS, qm.WIDTH), np.int64)
    for t in texts:
        bucket, _ = qm.buckets(Text(pa.array([t], pa.string())))
        for i, b in enumerate(bucket):
            for j in range(max(0, i - qm.REACH), min(len(bucket), i + qm.REACH + 1)):
                if i != j:
                    want[b, places[bucket[j]]] += signs[bucket[j]].astype(int)
    assert (got == want).all()


def test_pooling_matches_brute_force():
    vectors = np.random.default_rng(1).normal(size=(qm.BUCKETS, qm.WIDTH)).astype(np.float32)
    text = Text(pa.array(["a b c", None, "one", "", "b b b !!"]))
    got = qm.pooled(text, vectors)
    bucket, first = qm.buckets(text)
    for k in range(5):
        v = vectors[bucket[first[k] : first[k + 1]]]
        if len(v):
            near = (v[:-1] * v[1:]).sum(axis=0) / max(1, len(v) - 1)
            assert got[k] == pytest.approx(np.concatenate([v.mean(axis=0), v.std(axis=0), near]), abs=1e-3)
        else:
            assert not got[k].any()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < learning.sigmoid(z)).astype(int)
    assert learning.temperature(5 * z, y) == pytest.approx(5, rel=0.2)


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rows = [(k, CLEAN + f" {k} " + CLEAN if k % 2 else "BUY!! NOW!! " * 9 + f"{k}") for k in range(240)]
    docs = documents([*rows, (900, None), (901, ""), (902, "word " * 30_000), (3, CLEAN)]).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(240)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    out = qm.classify(docs, labels).collect()
    assert len(out) == 244 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 240]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_are_not_read(spark, documents):
    docs = documents([(k, f"{CLEAN} {k}") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    changed = labels.withColumn("quality", F.when(learning.fold(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (sorted((r.doc_id, r.score) for r in qm.classify(docs, x).collect()) for x in (labels, changed))
    assert first == second


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(0, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0)], 1.0)])
def test_one_class_or_none(spark, documents, labels, score):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in qm.classify(documents(["a", "b", None, "d", "e", "f"]), table).collect()} == {score}


def test_empty_table(spark, documents):
    assert qm.classify(documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_caps_of_the_sample_do_not_move_the_prior(spark, documents):
    """The text says nothing, so the score is the label's share, whatever share of each class is learnt from."""
    docs = documents(["the same words in all of them"] * 900)
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(900)], "doc_id long, quality int")
    share = labels.filter(~learning.fold(F.col("doc_id"), 3, 1)).agg(F.avg("quality")).first()[0]
    model = qm.train(docs, labels, sample={0: 50, 1: 50})
    assert model[1].shift == pytest.approx(np.log(share / (1 - share)))
    assert qm.score(docs, model).first().score == pytest.approx(share, abs=0.08)
