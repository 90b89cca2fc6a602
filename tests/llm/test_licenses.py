import re
from collections import Counter

import pytest

from tessalith.llm import licenses as lc

BODY = "words of a plain text that says nothing at all about any terms"


def bag(text):
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()) if x]
    return Counter(zip(w, w[1:]))


def brute(text):
    text = text or ""
    segments = [*text.split("\n"), *re.split(r"\n\n+", text), text]
    out = {}
    for name, texts in lc.TEMPLATES.items():
        for k, template in enumerate(texts):
            b = bag(template)
            for s in segments:
                a = bag(s)
                if a:
                    dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                    if dice >= lc.LEAST:
                        out[name, k] = max(dice, out.get((name, k), 0))
    return out


MIT = lc.TEMPLATES["MIT"][0]
ROWS = [
    (0, f"{BODY}\nLicensed under the Apache License, Version 2.0.\n{BODY}"), (1, None), (2, ""), (3, BODY), (4, MIT), (4, MIT),
    (5, f"{BODY}\n\n" + MIT.replace(". ", ".\n") + f"\n\n{BODY}"), (6, MIT.replace("Software", "Program").upper()),
    (7, "released under the mit licence"), (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0."), (9, f"{BODY}\n" * 4000 + "Released under the MIT License."),
    (10, "License"), (11, "\n\n\n"), (12, "MIT License MIT License MIT License"),
]


def test_matches_are_those_of_brute_force(documents):
    docs = documents(ROWS)
    rows = lc.scan(docs.withColumn("license", docs.text)).collect()
    got = sorted((r.doc_id, r.license, r.template, r.dice) for r in rows)
    want = sorted((i, *key, dice) for i, t in ROWS for key, dice in brute(t).items())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)
    assert {(0, "Apache-2.0"), (4, "MIT"), (5, "MIT"), (9, "MIT")} <= {g[:2] for g in got}


def test_places_hold_the_segment(documents):
    for r in lc.scan(documents(ROWS)).collect():
        text = next(t for i, t in ROWS if i == r.doc_id)
        segment = text.lower().encode()[r.begin : r.end].decode()
        a, b = bag(segment), bag(lc.TEMPLATES[r.license][r.template])
        assert 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) == pytest.approx(r.dice, abs=1e-6)


def test_empty_table(documents):
    assert lc.scan(documents([])).count() == 0


PUBLISHED = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")


def test_licences_in_several_paragraphs_and_short_notices(documents):
    around = f"{BODY}\n" * 30
    wrapped = " ".join(x + "\n" * (k % 9 == 8) for k, x in enumerate(MIT.split()))
    rows = [
        (0, around + PUBLISHED + "\n\n" + around), (1, PUBLISHED), (2, around + "All rights reserved.\n" + around), (3, "Copyright 2020 A. Person. All rights reserved. " + BODY),
        (4, f"{BODY} {MIT} {BODY} " * 2), (5, f"{around} this file is released under the\nMIT License. {BODY}"), (6, f"{BODY} {wrapped} {BODY}"),
        (7, f"{BODY} " + " ".join(x + " (new)" * (k % 40 == 39) for k, x in enumerate(MIT.split())) + f" {around}"), (8, "all reserved rights\nall\n\nrights"), (9, f"{BODY}\n{BODY}"),
    ]
    found = {(r.doc_id, r.license): r for r in lc.scan(documents(rows)).collect()}
    assert set(found) == {(k, "MIT") for k in (0, 1, 4, 5, 6, 7)} | {(2, "Proprietary"), (3, "Proprietary")}
    assert all(found[k].dice == 1 for k in found if k != (7, "MIT"))
    for k in (0, 1, 4, 6):
        segment = rows[k][1].lower().encode()[found[k, "MIT"].begin : found[k, "MIT"].end].decode()
        assert bag(segment) == bag(MIT)


def test_full_texts_inside_documents_are_found(documents):
    import random

    rng, templates = random.Random(3), lc.all_templates()
    names = sorted(p.name for p in lc.TEXTS.iterdir())
    rows = []
    for k, name in enumerate(names):
        words = templates[name][-1].split()
        for _ in range(len(words) // 50):  # some words differ
            words[rng.randrange(len(words))] = "changed"
        rows += [(2 * k, f"{BODY}\n{templates[name][-1]}\n{BODY}"), (2 * k + 1, f"{BODY} " * 300 + " ".join(words) + f" {BODY}" * 300)]
    got = {(r.doc_id, r.license): r.dice for r in lc.scan(documents(rows)).collect() if r.template == len(templates[r.license]) - 1}
    for k, name in enumerate(names):
        assert got[2 * k, name] >= 0.98 and got[2 * k + 1, name] >= 0.9, name
