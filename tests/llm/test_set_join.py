import random
import re

import numpy as np
import pytest

from tessalith.llm import components as cc
from tessalith.llm import set_join as sj


def shingles(text, width=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows):
    """(id, set size, component) by comparing all pairs; rows with one id are one vertex."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets)


def corpus(seed, groups=6, size=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows, k = [], 0
    for _ in range(groups):
        root = [word() for _ in range(rng.randint(40, 90))]
        for _ in range(rng.randint(1, size)):
            text = list(root)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[: -rng.randint(1, 15)]
            if rng.random() < 0.2:
                text += passage
            rows.append((k, " ".join(text)))
            k += 1
            if rng.random() < 0.3:
                root = text  # chains of copies of copies
    rows += [(k + j, " ".join([word() for _ in range(20)] + passage)) for j in range(25)]
    rng.shuffle(rows)
    return rows


def found(docs):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in sj.near_duplicates(docs).collect())


@pytest.mark.parametrize("small", [False, True])
def test_components_match_brute_force(documents, monkeypatch, small):
    if small:  # several chunks, blocks, visitors' groups and columns even here
        for name, value in (("CHUNK", 300), ("BLOCK_SETS", 3), ("BLOCK_SHINGLES", 200), ("COLUMNS", 7), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(sj, name, value)
    rows = corpus(11) if small else corpus(12, groups=10, size=20)
    assert found(documents(rows).repartition(3)) == brute(rows)


def test_odd_rows(documents):
    text = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(10, text), (4, text.upper()), (7, None), (8, ""), (9, " \n"), (3, "one two"), (2, "ONE  two"), (1, "one two three"), (5, text + " u"), (5, text + " u"), (6, "z " * 20_000), (11, "É b c d e"), (12, "é b c d e")]
    docs = documents(rows)
    got = found(docs.withColumn("n", docs.n_chars).withColumn("rep", docs.text).withColumn("c", docs.lang))
    assert got == brute(rows)
    assert (10, 16, 4) in got and (3, 1, 2) in got and (1, 1, 1) in got and (11, 1, 11) in got


def test_empty_table_and_null_id(spark, documents):
    assert found(documents([])) == []
    rows = sj.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == [("3", 2, "3"), ("None", 1, "None"), ("None", 2, "3")]


def test_answers_from_the_pivot_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), dtype=np.uint64)) for _ in range(30)]
    for pivot in (sets[0], np.zeros(0, np.uint64)):
        own = sj.Answers(pivot, sets).overlaps(np.arange(30), np.arange(30))
        assert (own == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.v: r.c for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_sets_that_only_rows_without_id_have_link(spark):
    rng = random.Random(8)
    root = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    between = [*root[:-6], *(f"x{k}" for k in range(6))]
    far = [*(f"y{k}" for k in range(4)), *between[4:]]
    alone = [f"z{k}" for k in range(30)]
    rows = [(7, root), (None, between), (9, far), (None, alone), (None, [*alone, "end"]), (11, ["other"] * 9)]
    assert len({tuple(root[i:i + 5]) for i in range(56)} & {tuple(far[i:i + 5]) for i in range(56)}) < 0.85 * 56
    got = sj.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id or r.component_id) == [(-1, 7), (7, 7), (9, 7), (11, 11)]
    assert sum(r.doc_id is None and r.component_id is None for r in got) == 2


def test_texts_of_one_id_are_one_document(documents):
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    one, two, three = text(50), text(50), text(50)
    rows = [(4, one), (9, one[2:]), (9, two), (6, two[:-3]), (7, three), (7, text(9)), (3, three[1:]), (8, []), (8, three[2:])]
    rows = [(i, " ".join(t)) for i, t in rows]
    assert found(documents(rows)) == brute(rows)


@pytest.mark.parametrize("buckets", [4, 400, 40_000])
def test_messages_grow_with_keys_not_with_buckets(buckets):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    keys = np.concatenate([keys, keys[:100]])
    rows, local = sj.messages(5, keys, np.arange(len(keys)) % 11, 11, buckets)
    assert len(rows) <= min(buckets, 1000) and local.sum() == 200
    assert sum(len(x) for x in rows.column("keys").to_pylist()) == 4 * 900 == sum(len(x) for x in rows.column("owners").to_pylist())
    assert sum(len(x) for x in rows.column("several").to_pylist()) == 4 * 100
    for chunk, b, k in zip(*(rows.column(c).to_pylist() for c in ("chunk", "bucket", "keys"))):
        own = keys[sj.bucket_of(keys, buckets) == b].astype("<u4")
        assert chunk == 5 and set(np.frombuffer(k, "<u4").tolist()) <= set(own.tolist())


def test_pairs_that_cannot_link_are_left_out_by_the_pivot():
    rng = np.random.default_rng(4)
    near = [np.unique(np.concatenate([np.arange(60, dtype=np.uint64), rng.integers(100, 10**6, 4, dtype=np.uint64)])) for _ in range(5)]
    far = [np.unique(rng.integers(10**6, 10**7, 60, dtype=np.uint64)) for _ in range(5)]
    answers = sj.Answers(near[0], near + far)
    places = np.arange(10)
    hope = answers.hopeful(places[:5], places[5:], 75)
    assert not hope.any() and answers.links(places, places, 75)[:5, :5].sum() == 20
