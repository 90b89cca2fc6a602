import numpy as np
import pyarrow as pa
import pytest

from tessalith.llm import language_id as li
from tessalith.llm.kernel import Text

EN = "the house by the river and the people of the town with their dogs in the morning"
DE = "das Haus am Fluss und die Leute der Stadt mit ihren Hunden am frühen Morgen schön"
FR = "la maison près de la rivière et les gens de la ville avec leurs chiens dès le matin"


def test_segments_cover_every_byte_once():
    texts = ["a" * n for n in (1, 47, 48, 49, 96, 100, 500)] + [None, "", "é" * 60, "ab 12 !c"]
    text = Text(pa.array(texts))
    data, row, letters = li.segments(text)
    want = [sum(b >= 128 or chr(b).isalpha() for b in (t or "").encode()) for t in texts]
    assert np.bincount(row, letters.sum(axis=1), len(texts)).tolist() == want
    assert data.shape == letters.shape == (len(row), li.SPAN)


def test_gradients_match_finite_differences():
    network = li.Network(["x", "y", "z"], seed=1)
    for name in ("x", "u", "v"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, (5, 6)).astype(np.uint8)
    label, weight = np.array([0, 1, 2, 1, 0]), rng.random((5, 6))
    _, gradients = network.gradients(data, label, weight)
    for name, gradient in zip(("x", "u", "v", "b"), gradients, strict=True):
        own = getattr(network, name)
        places = [tuple(rng.integers(0, s) for s in own.shape) for _ in range(12)]
        if name == "x":
            places = [(p[0], p[1], int(rng.integers(97, 101))) for p in places]
        for p in places:
            kept, step = own[p], 3e-2
            own[p] = kept + step
            up, _ = network.gradients(data, label, weight)
            own[p] = kept - step
            down, _ = network.gradients(data, label, weight)
            own[p] = kept
            assert gradient[p] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def rows(n=240):
    rng, out = np.random.default_rng(5), []
    for k in range(n):
        words = (EN, DE, FR)[k % 3].split()
        out.append((k, " ".join(rng.choice(words, 25)), ("en", "de", "fr")[k % 3], None))
    return out


def test_held_out_accuracy_and_odd_rows(documents):
    more = [(900, None, "en", None), (901, "", "en", None), (902, "12 !? 3", "fr", None), (903, "“…” ‘’", "fr", None), (904, FR, None, None), (905, f"{DE} " * 900, None, None), (3, EN, "en", None)]
    out = li.identify(documents(rows() + more)).collect()
    assert len(out) == 247
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (900, 901, 902, 903))
    assert by_id[904].lang_pred == "fr" and by_id[905].lang_pred == "de"
    held = [r for r in out if r.held_out and r.doc_id < 240 and r.doc_id != 3]
    assert len(held) > 20 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] for r in held) >= 0.95 * len(held)


def test_one_language_or_none(documents):
    one = li.identify(documents([(k, EN, "en", None) for k in range(8)] + [(9, "7", None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in one if r.doc_id < 9} == {("en", 1.0)} and one[-1].lang_pred == "und"
    none = li.identify(documents([(k, EN, None, None) for k in range(4)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_empty_table(documents):
    assert li.identify(documents([])).count() == 0
