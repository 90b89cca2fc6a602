import random

import numpy as np
import pyarrow as pa
import pytest

from tessalith.llm import paragraphs as pg
from tessalith.llm import set_join as sj
from tessalith.llm.kernel import Text, words


def babble(rng, n):
    return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(1)) for _ in range(n)]


def cut(texts):
    return pg.Paragraphs(words(Text(pa.array(texts, pa.string()))))


def test_paragraphs_cover_texts_and_do_not_depend_on_what_is_around():
    rng = random.Random(1)
    passage = babble(rng, 80)
    texts = [" ".join(babble(rng, 70) + passage + babble(rng, 60)), " ".join(babble(rng, 33) + passage), "one two", None, " ".join(passage)]
    found = cut(texts)
    runs = words(Text(pa.array(texts)))
    assert all(runs.first[r] <= a < b <= runs.first[r + 1] and b - a >= pg.WIDTH for a, b, r in zip(found.begin, found.end, found.row))
    places = {}
    for k in range(len(found)):
        places.setdefault(int(found.row[k]), set()).add(found.set_of(k).tobytes())
    assert len(places[0] & places[1] & places[4]) >= 5 and 2 not in places and 3 not in places


def test_every_passage_of_51_words_holds_a_whole_paragraph():
    rng = random.Random(2)
    missed = 0
    for _ in range(300):
        passage = babble(rng, 51)
        a, b = (cut([" ".join(babble(rng, 20) + passage + babble(rng, 20))]) for _ in (0, 1))
        missed += not {a.set_of(k).tobytes() for k in range(len(a))} & {b.set_of(k).tobytes() for k in range(len(b))}
    assert missed <= 3


def test_bands_reach_their_recall():
    rng = np.random.default_rng(3)
    hit = 0
    for _ in range(400):
        union = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sets = union[:35], union[5:]  # 30 of 40: similarity 0.75
        found = pg.Paragraphs(words(Text(pa.array([""]))))
        keys = []
        for s in sets:
            found.begin, found.shingle, found.first = np.zeros(1), s, np.array([0, len(s)])
            keys.append(found.keys())
        hit += (keys[0] == keys[1]).any()
    assert hit / 400 >= pg.RECALL - 0.015


@pytest.mark.parametrize("small", [False, True])
def test_passages_are_found_and_clean_documents_left_alone(documents, monkeypatch, small):
    if small:
        for module, name, value in ((sj, "BLOCK_SETS", 2), (sj, "COLUMNS", 5), (pg, "CHUNK", 200), (pg, "BROADCAST_ROWS", 0)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(4)
    passages = [babble(rng, n) for n in (55, 60, 90)]
    short = babble(rng, 10)
    rows, planted = [], {}
    for k in range(60):
        text = babble(rng, rng.randint(60, 120))
        if k % 3 == 0:
            which = (k // 3) % 3
            at = rng.randrange(len(text))
            text[at:at] = passages[which]
            planted[k] = which
        elif k % 3 == 1:
            text[5:5] = short
        rows.append((k, " ".join(text).replace(" ", "\n", 1)))
    rows += [(100, rows[2][1]), (101, None), (102, ""), (103, "few words"), (104, "z " * 20_000), (50, rows[50][1])]
    docs = documents(rows)
    got = pg.repeated_passages(docs.withColumn("begin", docs.text).withColumn("sig", docs.lang)).collect()
    assert {r.doc_id for r in got} == {*planted, 2, 100}
    for r in got:
        if r.doc_id in planted:
            # At a passage's edge a paragraph may be cut alike in some of the documents only.
            assert planted[r.first_doc_id] == planted[r.doc_id] and r.removed == (r.doc_id != r.first_doc_id)
    for d, which in planted.items():
        first = min(k for k, w in planted.items() if w == which)
        assert sum(r.n_words for r in got if r.doc_id == d and r.first_doc_id == first) >= 30
    assert {r.first_doc_id for r in got if r.doc_id == 100} == {2}
    longest = {d: sum(r.n_words for r in got if r.doc_id == d) for d in planted}
    assert all(longest[d] >= len(passages[w]) - 25 for d, w in planted.items())


def test_empty_table_and_null_ids(spark, documents):
    assert pg.repeated_passages(documents([])).count() == 0
    text = " ".join(babble(random.Random(5), 60))
    other = " ".join(["x", *text.split()[:-1]])
    rows = pg.repeated_passages(spark.createDataFrame([(None, text), (1, other), (1, other), (None, "")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {None, 1} and {r.first_doc_id for r in rows} == {1} and all(r.removed == (r.doc_id is None) for r in rows)
    # Equal rows are one document: nothing is repeated.
    assert pg.repeated_passages(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).count() == 0


def test_links_within_groups_match_brute_force(monkeypatch):
    rng = np.random.default_rng(9)
    for at_once in (7, 10**6):
        monkeypatch.setattr(pg, "PAIRS_AT_ONCE", at_once)
        base = [rng.integers(0, 40, 14, dtype=np.uint64) for _ in range(4)]
        sets = [np.unique(np.concatenate([base[rng.integers(4)][: rng.integers(8, 15)], rng.integers(50, 90, rng.integers(0, 4), dtype=np.uint64)])) for _ in range(60)]
        group = np.sort(rng.integers(0, 5, 60))
        label = pg.verified_links(group, sets, 75)
        want = np.arange(60)
        for _ in range(60):
            for x in range(60):
                for y in range(60):
                    both = len(np.intersect1d(sets[x], sets[y]))
                    if group[x] == group[y] and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                        want[x] = min(want[x], want[y])
        assert (label == want).all()


@pytest.mark.parametrize("hot", [2, 256])
def test_links_of_colliding_paragraphs_reach_the_recall_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(pg, "HOT", hot)
    rng = np.random.default_rng(5)
    sets, pairs = [], set()
    for k in range(120):
        root = rng.integers(0, 2**62, 24, dtype=np.uint64)
        for cut in (0, *rng.integers(1, 7, 2)):
            sets.append(np.unique(np.concatenate([root[: 24 - cut], rng.integers(0, 2**62, rng.integers(0, 3), dtype=np.uint64)])))
    for x in range(len(sets)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                pairs.add((x, y))
    found = pg.Paragraphs(words(Text(pa.array([""]))))
    found.begin, found.shingle, found.first = np.zeros(len(sets)), np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = [(k, bytearray(s.astype("<u8").tobytes()), keys) for k, (s, keys) in enumerate(zip(sets, found.keys().view(np.int64).tolist()))]
    parts = {r.v: r.c for r in pg.link_components(spark.createDataFrame(rows, "rep long, set binary, keys array<long>")).collect()}
    caught = sum(parts.get(x, -1) == parts.get(y, -2) for x, y in pairs)
    assert len(pairs) > 150 and caught / len(pairs) >= 0.95
    for v, c in parts.items():  # nothing is joined without links
        assert v // 3 == c // 3


def test_a_passage_with_an_edit_inside_is_found(documents):
    rng = random.Random(6)
    rows, edited = [], 0
    for k in range(40):
        passage = babble(rng, 55)
        changed = [*passage[:27], babble(rng, 1)[0], *passage[28:]]
        rows += [(2 * k, " ".join(babble(rng, 30) + passage + babble(rng, 30))), (2 * k + 1, " ".join(babble(rng, 33) + changed + babble(rng, 20)))]
    got = {r.doc_id for r in pg.repeated_passages(documents(rows)).collect()}
    assert sum({2 * k, 2 * k + 1} <= got for k in range(40)) >= 36
