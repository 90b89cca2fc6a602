import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessalith.llm import toxicity as tx
from tessalith.llm.kernel import Text

CALM = ["the garden is green", "we walk to the river", "a calm evening at home", "the train leaves at nine", "bread and cheese for lunch"]


def test_features_are_words_and_stems():
    rows = tx.features(Text(pa.array(["Garden garden GREEN!", None, "", "green garden", "gardening"])))
    assert rows[0].tolist() == rows[3].tolist() and not len(rows[1]) and not len(rows[2])
    assert set(rows[0]) & set(rows[4])
    assert all(r.tolist() == sorted(set(r.tolist())) for r in rows)


def test_swaps_keep_everything_but_the_names():
    copies = tx.swapped("A Muslim woman spoke.")
    assert len(copies) == 8 and all(re.fullmatch(r"A \w+ \w+ spoke\.", c) for c in copies)
    assert not any("muslim" in c.lower() for c in copies) and not tx.swapped("nobody here") and not tx.swapped("womankind")
    for group in tx.GROUPS:
        assert len(set(group)) == len(group) >= 3


def rows_with_bias():
    """Toxic sentences mostly name one group, calm ones rarely do."""
    rng, rows = np.random.default_rng(4), []
    for k in range(400):
        toxic = k % 2
        name = "muslim" if rng.random() < (0.6 if toxic else 0.05) else "person"
        rows.append((k, f"that {name} said {CALM[k % 5]}" + (" you idiot" if toxic and k % 3 else ""), toxic))
    return rows


def scored(pairs, penalty):
    own = [r for _, r, _ in pairs]
    x = tx.features(Text(pa.array(own)))
    swaps = [(k, z) for k, t in enumerate(own) for z in tx.features(Text(pa.array(tx.swapped(t), pa.string())))]
    return tx.fit(x, np.array([y for _, _, y in pairs]), swaps, penalty)


def test_the_penalty_lowers_neutral_mentions_only():
    rows = rows_with_bias()
    probe = Text(pa.array(["that muslim said the garden is green", "that christian said the garden is green", "that person is an idiot"]))
    plain, fair = (tx.scores(probe, *scored(rows, p)) for p in (0.0, tx.PENALTY))
    assert plain[0] - plain[1] > 0.2
    assert abs(fair[0] - fair[1]) < 0.1 and fair[0] < plain[0]
    assert fair[2] > 0.7


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rows = [(k, f"{CALM[k % 5]} {CALM[k % 3]} number {k}" + (" you stupid worthless clown" if k % 4 == 0 else "")) for k in range(300)]
    docs = documents([*rows, (900, None), (901, ""), (902, "word " * 30_000), (4, "x")])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    out = tx.classify(docs, labels).collect()
    assert len(out) == 304 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id != 4)
    assert all(not r.predicted for r in out if r.doc_id >= 900)


@pytest.mark.parametrize(("label", "score"), [(None, 0.0), (1, 1.0), (0, 0.0)])
def test_one_class_or_none(spark, documents, label, score):
    rows = [] if label is None else [(k, 1, label) for k in range(6)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.score for r in tx.classify(documents(["a", "b", None]), labels).collect()} == {score}


def test_empty_table(spark, documents):
    assert tx.classify(documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_caps_of_the_sample_do_not_move_the_prior(spark, documents):
    """The text says nothing, so the score is the label's share, whatever share of each class is learnt from."""
    docs = documents(["the same words in all of them"] * 900)
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(900)], "doc_id long, toxic int")
    share = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").agg({"toxic": "avg"}).first()[0]
    weights, bias = tx.train(docs, labels, sample={0: 50, 1: 50})
    assert tx.scores(Text(pa.array(["the same words in all of them"])), weights, bias)[0] == pytest.approx(share, abs=0.02)


def test_repeated_ids_and_labels_learn_from_one_row_each(spark, documents):
    from tessalith.llm.learning import labelled_sample

    rows = [(1, f"text {k}") for k in range(500)] + [(k, f"own {k}") for k in range(2, 60)] + [(70, None)]
    labels = spark.createDataFrame([(1, 1), (1, 1), *((k, k % 2) for k in range(2, 60)), (70, 0), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(documents(rows), labels, "toxic", "doc_id", "text", {0: 10, 1: 10}).collect()
    assert len({r.i for r in got}) == len(got) <= 20
    assert all(r.t == "text 0" for r in got if r.i == 1)
    everything = labelled_sample(documents(rows), labels, "toxic", "doc_id", "text", {0: 1000, 1: 1000}).collect()
    assert len({r.i for r in everything}) == len(everything) and all(r.w == 1.0 for r in everything)


def test_chosen_features_hold_all_that_fit_keeps(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["fine", "day", "walk", "muslim"]) for _ in range(9)) + (" vileword nasty" if k % 3 == 0 else "") for k in range(90)]
    sample = spark.createDataFrame([(k, t, int(k % 3 == 0), 1.0) for k, t in enumerate(texts)], "i long, t string, y int, w double")
    kept = set(tx.chosen_features(sample).tolist())
    rows = tx.features(Text(pa.array(texts)))
    weights, bias = tx.fit(rows, np.array([int(k % 3 == 0) for k in range(90)]), [])
    assert set(np.flatnonzero(weights).tolist()) <= kept and len(kept) < 1000
    again, same = tx.fit([np.array(sorted(set(r.tolist()) & kept), np.int32) for r in rows], np.array([int(k % 3 == 0) for k in range(90)]), [])
    assert np.allclose(weights, again) and bias == pytest.approx(same)
