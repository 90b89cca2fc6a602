import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessalith.llm import decontamination as dc
from tessalith.llm.kernel import Text


def brute(item, text):
    """Fewest edits that make the item a part of the text."""
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(item, text):
    row = list(range(len(text) + 1))
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), max_size=14))
def test_edits_match_brute_force(item, text):
    cost, begin, end = dc.edits(np.array(item, np.uint64), np.array(text, np.uint64))
    assert cost == brute(item, text)
    assert plain(item, text[begin:end]) == cost


def test_embedding_is_a_walk():
    words = np.arange(100, 130, dtype=np.uint64)
    out = dc.embed(words, np.array([0, 5]), np.array([12, 12]), 36)
    for row, start in ((0, 0), (1, 5)):
        path = [int(out[j, 0, row]) for j in range(36)]
        visited = [p for p in dict.fromkeys(path) if p]
        assert visited == list(range(100 + start, 100 + start + len(visited)))


WORDS = [a + b + c for a in ("al", "be", "co", "du", "er") for b in ("na", "ri", "to", "su", "ve", "li") for c in ("m", "nt", "x", "sh", "ck", "d", "g")]


def passages(rng, n, size):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(*size))) for _ in range(n)]


def test_recall_of_edited_items_and_no_false_rows(documents, spark):
    rng = random.Random(5)
    items = passages(rng, 30, (20, 45))
    rows, planted = [], set()
    for k in range(200):
        text = passages(rng, 1, (100, 300))[0].split()
        if k % 2:
            item = rng.randrange(len(items))
            words = items[item].split()
            for _ in range(int(0.1 * len(words))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [words[at], rng.choice(WORDS)]])
            at = rng.randrange(len(text))
            text[at:at] = words
            planted.add((k, item))
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.find_contamination(documents(rows), bench).collect()}
    limit = [int(dc.MAX_RATE * len(i.split())) for i in items]
    true = {(k, i) for k, t in rows for i, item in enumerate(items) if (k, i) in planted and brute(item.split(), t.split()) <= limit[i]}
    assert found <= planted
    assert len(found & true) >= 0.95 * len(true)


@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
@pytest.mark.parametrize("size", [8, 20, 36, 60, 120])
def test_recall_at_every_rate_of_edits(rate, size):
    rng = np.random.default_rng([size, int(100 * rate)])
    word = lambda n: rng.integers(1, 2**62, n, dtype=np.uint64)
    items = [word(size) for _ in range(25)]
    known = dc.Items(list(enumerate(items)), dc.MAX_RATE)
    caught = tried = 0
    for k in range(150):
        words = items[k % 25].tolist()
        for _ in range(int(rate * size)):
            at = int(rng.integers(len(words)))
            words[at : at + 1] = [[], word(1).tolist(), [words[at], *word(1).tolist()]][int(rng.integers(3))]
        text = np.concatenate([word(40), np.array(words, np.uint64), word(40)])
        if brute(items[k % 25].tolist(), text.tolist()) <= int(dc.MAX_RATE * size):
            tried += 1
            caught += any(item == k % 25 for _, item, *_ in known.matches(text, np.array([0, len(text)])))
    assert tried > 100 and caught >= 0.95 * tried


def test_words_of_any_script():
    texts = ["Zwei „Wörter“, drei…", "日本語の文", "«Привет», мир", "ภาษาไทย x", "a\u00a0b", "é-è 한국어", "x", None]
    text = Text(pa.array(texts))
    runs, _ = dc.normal_words(text)
    got = [[text.data[a:b].tobytes().decode() for a, b in zip(runs.starts[x:y], runs.ends[x:y])] for x, y in zip(runs.first, runs.first[1:])]
    assert got == [["Zwei", "Wörter", "drei"], list("日本語の文"), ["Привет", "мир"], [*"ภาษาไทย", "x"], ["a", "b"], ["é", "è", "한국어"], ["x"], []]


def test_an_item_in_a_script_without_spaces_is_found_inside_a_text(spark, documents):
    item = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    docs = [(0, f"これは{item}という詩です"), (1, f"これは{item[:9]}X{item[10:]}という詩です"), (2, "これは別の文です"), (3, f"“{item}”")]
    got = run(spark, documents, docs, [(5, item)])
    assert [(d, e) for d, _, _, _, e in got] == [(0, 0), (1, 1), (3, 0)]


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def run(spark, documents, docs, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits) for r in dc.find_contamination(documents(docs), bench, **more).collect())


def test_odd_rows(spark, documents):
    docs = [(0, None), (1, ""), (2, f"x {ITEM.upper()}, y"), (2, ITEM), (3, f"{ITEM} and {ITEM}"), (4, "a b c short item d"), (5, "short items"), (6, "z " * 40_000 + ITEM), (7, "--- !!!")]
    items = [(0, ITEM), (1, None), (2, ""), (3, "short item"), (3, "short item"), (9, "***")]
    got = run(spark, documents, docs, items)
    assert got == [(2, 0, 0, 14, 0), (2, 0, 1, 15, 0), (3, 0, 0, 14, 0), (3, 0, 15, 29, 0), (4, 3, 3, 5, 0), (4, 3, 3, 5, 0), (6, 0, 40_000, 40_014, 0)]
    assert run(spark, documents, docs, items, at_once=20) == got


@pytest.mark.parametrize(("docs", "items"), [([], [(0, ITEM)]), ([(0, ITEM)], []), ([], [])])
def test_empty_tables(spark, documents, docs, items):
    assert run(spark, documents, docs, items) == []


def test_members():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)
    members = dc.Members(values)
    assert members.has(values).all()
    assert not members.has(values + np.uint64(1)).any()
    assert not dc.Members(np.zeros(0, np.uint64)).has(values).any()
