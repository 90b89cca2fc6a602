"""The written cases and random texts of several entities against the plain loops of ``tests/plain.py``."""

import random

import pytest
from pyspark.sql import functions as F

from tessalith.functions import scores as S
from tessalith.functions import text as T
from tessalith.functions.normalise import spoken_numbers
from tessalith.operators import scoring
from tessalith.plans import cases
from tests import plain

HOW = (T.DOSE_UNITS, T.NEGATION_CUES, T.SPOKEN_PUNCTUATION)


def test_written_numbers_are_those_of_plain_loops():
    for c in cases.PAIRS:
        assert c.scores == tuple(round(x, 9) if isinstance(x, float) else x for x in plain.scores(c.plain_reference, c.plain_hypothesis, set(cases.LEXICON), *HOW))
        assert list(c.findings) == plain.findings(c.plain_reference, c.plain_hypothesis, set(cases.LEXICON), *HOW)


PIECES = [*cases.LEXICON, "amoxapin", "warfarine", "5 mg", "10 mg", "10 ml", "10 cc", "20 µg", "2.5 mcg", "3 tablet", "no", "not", "denies", "negative for", "without", "comma", "full stop", "fever", "cough", "pain", "x/no", "5mg", "no.", "the", "and"]


def pairs(n):
    rng = random.Random(17)
    for _ in range(n):
        ref = [rng.choice(PIECES) for _ in range(rng.randint(0, 14))]
        hyp = [w for w in ref if rng.random() < 0.8]
        for _ in range(rng.randint(0, 3)):
            hyp.insert(rng.randint(0, len(hyp)), rng.choice(PIECES))
        yield " ".join(ref), rng.choice([" ".join(hyp), " ".join(hyp), " ".join(ref), None])


def test_scores_and_findings_of_random_texts(spark):
    rows = [(f"{k:04d}", "p", "x", "A", "clinical", 1.0, r, h) for k, (r, h) in enumerate(pairs(400))]
    df = spark.createDataFrame(rows, "clip_id string, provider string, accent string, tier string, domain string, duration double, reference string, hypothesis string")
    lexicon = spark.createDataFrame([(t,) for t in cases.LEXICON], "term string")
    for merged in (df, scoring.with_parts(df, lexicon)):
        scored = scoring.score_clips(merged, lexicon, normalised_already=True).orderBy("clip_id").collect()
        found = {}
        for f in scoring.all_findings(merged, lexicon, normalised_already=True).orderBy("clip_id", "position").collect():
            found.setdefault(f.clip_id, []).append((f.kind, f.expected, f.heard, f.ref_index))
        for row, got in zip(rows, scored, strict=True):
            want = plain.scores(row[6], row[7], set(cases.LEXICON), *HOW)
            assert tuple(got[c] for c in S.SCORES) == pytest.approx(want), row
            assert found.get(row[0], []) == plain.findings(row[6], row[7], set(cases.LEXICON), *HOW), row


def test_pairs_of_very_many_words(spark):
    n = 42_500
    rows = [(" ".join(f"w{k}" for k in range(n)), " ".join(f"w{k}" for k in range(1, n)))]
    edits = spark.createDataFrame(rows, "a string, b string").select(F.size(F.array_distinct(F.concat(T.words(F.col("a")), T.words(F.col("b"))))))
    assert edits.first()[0] > 0xD7FF - 0x3400
    few = spark.createDataFrame([("a b c d", "a x c")], "a string, b string")
    wide = S.MOST_WORDS
    assert wide > 10**6 and few.select(S.word_error_rate(F.col("a"), F.col("b"))).first()[0] == 0.5


@pytest.mark.parametrize(("words", "digits"), [("one hundred and one", "101"), ("twenty one hundred", "2100"), ("forty second", "42nd"), ("two thirds", "2 thirds"), ("percent of", "percent of"), ("ten euros and five cents", "€10 and ¢5"), ("sixteenth", "16th"), ("eleventh", "11th"), ("hundred and", "hundred and"), ("double trouble", "double trouble")])
def test_number_words(words, digits):
    assert spoken_numbers(words) == digits
