import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessalith.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        over = {s for s in names if s not in capped and left * weight[s] / free > most * sizes[s] + 1e-9}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else left * weight[s] / free for s in names}
        capped |= over


ROWS = [(k, "w " * (k % 13), None, [None, "a", "b", "c", "d"][min(k % 9, 4)]) for k in range(200)]
ROWS += [(5, "again and again", None, "a"), (5, "again and again", None, "a"), (300, None, None, "b"), (301, "", None, None), (302, "x " * 5000, None, "zé"), (303, "", None, "empty")]


def key(doc_id, text):
    text = hashlib.md5((text or "").encode()).hexdigest()
    return hashlib.md5(f"{'' if doc_id is None else doc_id}|{text}".encode()).hexdigest()


def test_targets_and_taken_match_brute_force(documents):
    rows = mixing.placed(documents(ROWS)).collect()
    texts = {key(i, t): (t, s) for i, t, _, s in ROWS}
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + size(text)
    targets = brute_targets(sizes)
    assert len(rows) == len(ROWS)
    of = lambda r: None if r.source == "n" else r.source[1:]
    for r in rows:
        text, _ = texts[r.key]
        assert r.source_size == sizes[of(r)] and r.target == pytest.approx(targets[of(r)])
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == size(text)
    for s in sizes:
        assert sum(r.taken for r in rows if of(r) == s) == int(targets[s] + 1e-9)
        before = 0
        for r in sorted((r for r in rows if of(r) == s), key=lambda r: (r.key, r.nth)):
            assert r.before == before
            before += r["size"]


def test_the_mix_is_what_the_sorted_curriculum_holds(documents):
    docs = documents(ROWS)
    mixed = mixing.mix(docs).collect()
    placed = {(r.id, r["size"], r.taken): r for r in mixing.placed(docs).collect()}
    assert sorted((r.doc_id, r["size"], r.taken) for r in mixed) == sorted((r.id, r["size"], r.taken) for r in mixing.placed(docs).collect())
    assert sum(r.copies for r in mixed) == sum(r.copies for r in placed.values()) + sum(r.copies for r in mixing.placed(docs).collect() if r.nth)
    copies = mixing.ranked(mixing.copies_of(mixing.placed(docs), mixing.WEIGHTS, None)).collect()
    assert sorted(r["rank"] for r in copies) == list(range(len(copies)))
    in_order = sorted(copies, key=lambda r: r["rank"])
    assert [(r.position, r.source, r.key, r.nth, r.copy) for r in in_order] == sorted((r.position, r.source, r.key, r.nth, r.copy) for r in copies)
    assert {r.first_rank for r in mixed if r.copies} <= {r["rank"] for r in copies if r.copy == 0} and all((r.first_rank is None) == (r.copies == 0) for r in mixed)


def test_finer_groups_give_the_same(documents, monkeypatch):
    first = sorted(map(str, mixing.mix(documents(ROWS)).collect()))
    monkeypatch.setattr(mixing, "GROUP_ROWS", 3)
    assert sorted(map(str, mixing.mix(documents(ROWS)).collect())) == first


@pytest.mark.parametrize("broadcast", [0, 100])
def test_curriculum_is_sorted_and_holds_what_is_taken(documents, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    clashing = ("size", "target", "__size", "__out", "source_size", "key", "rows", "words")
    docs = documents(ROWS).withColumns({c: F.lit(k) for k, c in enumerate(clashing)})
    rows = mixing.curriculum(docs).collect()
    positions = [r["__position"] for r in rows]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    taken = sum(r.taken for r in mixing.mix(documents(ROWS)).collect())
    assert sum(r["__words"] for r in rows) == taken == sum(size(r.text) for r in rows)
    cut = [r for r in rows if r["__words"] < size(dict((k, t) for k, t, *_ in ROWS)[r.doc_id]) and r.doc_id != 5]
    assert len(cut) <= 8 and set(docs.columns) < set(rows[0].asDict()) and rows[0]["__out"] == 3


def test_other_weights_and_rows_of_one_id(documents):
    rows = [(None, f"text {k} of many", None, "s") for k in range(30)] + [(1, "same same", None, "t")] * 40 + [(2, "x " * 30, None, "u")]
    mixed = mixing.mix(documents(rows), weights=(7, 3)).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    sizes = {"s": 120, "t": 80, "u": 30}
    targets = brute_targets(sizes, (7, 3))
    by_size = {4: "s", 2: "t", 30: "u"}
    for n, s in by_size.items():
        assert sum(r.taken for r in mixed if r["size"] == n) == int(targets[s] + 1e-9)
    assert len(mixing.curriculum(documents(rows), weights=(7, 3)).collect()) == sum(r.copies for r in mixed)


@pytest.mark.parametrize("weight", mixing.SCHEDULES)
def test_position_inverts_the_integral(spark, weight):
    knots = mixing.SCHEDULES[weight]

    def height(t):
        for (a, x), (b, y) in zip(knots, knots[1:]):
            if t <= b:
                return x + (y - x) * (t - a) / (b - a)

    steps = 20_000
    shares = [0.0, 0.1, 0.35, 0.5, 0.77, 1.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.position_of(F.col("s"), knots)).collect()]
    total = sum(height((k + 0.5) / steps) for k in range(steps))
    for s, t in zip(shares, got):
        assert sum(height((k + 0.5) / steps) for k in range(int(t * steps))) / total == pytest.approx(s, abs=2e-4)


def test_empty_table(documents):
    assert mixing.mix(documents([])).count() == 0 and mixing.curriculum(documents([])).count() == 0
