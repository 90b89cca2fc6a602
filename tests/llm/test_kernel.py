import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessalith.llm import kernel

TEXTS = st.lists(st.none() | st.text(alphabet="ab Cé\t\n\x0b\x0c\r\x1c\x85\xa0日", max_size=40), max_size=12)


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    text = kernel.Text(pa.array(texts, pa.string()))
    runs = kernel.words(text)
    got = [[text.data[s:e].tobytes().decode() for s, e in zip(runs.starts[a:b], runs.ends[a:b])] for a, b in zip(runs.first, runs.first[1:])]
    assert got == [plain(t) for t in texts]


@settings(deadline=None)
@given(TEXTS)
def test_equal_hashes_are_equal_words(texts):
    text = kernel.Text(pa.array(texts, pa.string()))
    runs = kernel.words(text)
    h = runs.hashes(lower=True)
    seen = {}
    for k in range(len(runs)):
        word = text.data[runs.starts[k] : runs.ends[k]].tobytes().lower()
        assert seen.setdefault(word, h[k]) == h[k]
    assert len(set(seen.values())) == len(seen)


@settings(deadline=None)
@given(TEXTS, st.integers(1, 6))
def test_shingle_sets_match_brute_force(texts, width):
    text = kernel.Text(pa.array(texts, pa.string()))
    sets = kernel.shingle_sets(kernel.words(text), width)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    brute = []
    for t in texts:
        w = plain((t or "").translate(lower))
        brute.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    assert [len(s) for s in sets] == [len(b) for b in brute]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(brute[a] & brute[b])


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 0, 3, 200, 1)] + [None])], names=["t"])
    parts = list(kernel.slices(batch, "t", limit=10))
    assert sum(len(p) for p, _ in parts) == 7
    assert b"".join(t.data.tobytes() for _, t in parts) == b"x" * 259


def test_hashes_of_long_texts_are_those_of_short_slices(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abCé ") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(4)]
    runs = kernel.words(kernel.Text(pa.array(texts)))
    want = runs.hashes(), runs.hashes(lower=True)
    for size in (37, 100, 1000):
        monkeypatch.setattr(kernel, "SLICE_BYTES", size)
        again = kernel.words(kernel.Text(pa.array(texts)))
        assert (again.hashes() == want[0]).all() and (again.hashes(lower=True) == want[1]).all()
