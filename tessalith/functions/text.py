"""Words, entities and marks in normalised text, as column expressions.

Two tokenisers exist on purpose: ``words`` splits on white space and is what
positions count; ``lexed`` takes runs of word characters, slashes and full
stops and is what drug names and the index of a negation cue are found by.
"""

from __future__ import annotations

import difflib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Surface forms of dose units, the longer before what they contain.
DOSE_UNITS = (
    "times daily", "mg/dl", "ml/hr", "milligrams", "milligram", "micrograms", "microgram",
    "millilitres", "millilitre", "milliliters", "milliliter", "kilograms", "kilogram",
    "grams", "gram", "litres", "litre", "liters", "liter", "tablets", "tablet",
    "capsules", "capsule", "drops", "drop", "puffs", "puff", "units", "unit",
    "hours", "hour", "days", "day", "percent", "mmol", "meq", "mcg", "mg", "kg", "ml",
    "cc", "iu", "ug", "µg", "g", "l",
)

# The unit that stands for each other spelling.
UNIT_ALIASES = {
    "µg": "mcg", "ug": "mcg", "micrograms": "mcg", "microgram": "mcg",
    "cc": "ml", "millilitres": "ml", "millilitre": "ml", "milliliters": "ml", "milliliter": "ml",
    "milligrams": "mg", "milligram": "mg", "kilograms": "kg", "kilogram": "kg",
    "grams": "g", "gram": "g", "litres": "l", "litre": "l", "liters": "l", "liter": "l",
    "tablet": "tablets", "capsule": "capsules", "drop": "drops", "puff": "puffs",
    "unit": "units", "hour": "hours", "day": "days",
}

# Negation cues, the longest first.
NEGATION_CUES = ("negative for", "denies", "denied", "without", "never", "not", "no")

# Punctuation that speakers say, phrases before their parts.
SPOKEN_PUNCTUATION = (
    "open parenthesis", "close parenthesis", "open bracket", "close bracket", "open quote",
    "close quote", "open paren", "close paren", "question mark", "exclamation mark",
    "new paragraph", "forward slash", "new line", "next line", "full stop", "semicolon",
    "apostrophe", "backslash", "paragraph", "unquote", "bracket", "hyphen", "period",
    "comma", "colon", "quote", "slash", "dash",
)

LEXER = r"(?U)[\w/.]+"
_ANY = "|".join
DOSE = rf"(?U)(?<![\w.])(\d+(?:\.\d+)?)\s*({_ANY(map(re.escape, DOSE_UNITS))})(?![\w/])"
NEGATION = rf"(?U)(?<!\w)({_ANY(map(re.escape, NEGATION_CUES))})(?!\w)"
SPOKEN = rf"(?U)(?<!\w)(?:{_ANY(map(re.escape, SPOKEN_PUNCTUATION))})(?!\w)"
WINDOW = 5
EXCERPT_WIDTH = 15


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    """White-space tokens; the empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def lexed(text: Column) -> Column:
    return _all(text, LEXER, 0)


def drug_mentions(text: Column, lexicon: Column) -> Column:
    """Lexer tokens that are in ``lexicon`` (an array), in order, repeats kept."""
    return F.filter(lexed(text), lambda t: F.array_contains(lexicon, t))


def canonical_unit(unit: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, unit), unit)


def dose_pairs(text: Column) -> Column:
    """array<struct<value double, unit string>> of numbers with a unit right behind."""
    both = F.arrays_zip(_all(text, DOSE, 1).alias("value"), _all(text, DOSE, 2).alias("unit"))
    return F.transform(both, lambda p: F.struct(p["value"].cast("double").alias("value"), canonical_unit(p["unit"]).alias("unit")))


def negations(text: Column) -> Column:
    """array<struct<cue string, idx int>>; ``idx`` is the number of lexer tokens that start before the cue.

    Tokens are counted gap by gap (a gap is what a split by the cues leaves):
    one that goes on over a cue's edge, with a slash or a full stop, counts once.
    """
    cues = _all(text, NEGATION, 1)
    parts = F.arrays_zip(F.slice(F.split(text, NEGATION, -1), 1, F.size(cues)).alias("gap"), cues.alias("cue"))
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<cue:string,idx:int>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        gap = part["gap"]
        goes_on = F.when((state["n"] > 0) & gap.rlike(r"^[/.]"), 1).otherwise(0)
        idx = state["n"] + F.size(lexed(gap)) - goes_on
        hit = F.struct(part["cue"].alias("cue"), idx.alias("idx"))
        return F.struct((idx + F.size(lexed(part["cue"])) - F.when(gap.rlike(r"[/.]$"), 1).otherwise(0)).alias("n"), F.concat(state["found"], F.array(hit)).alias("found"))

    found = F.aggregate(parts, empty, step, lambda state: state["found"])
    return F.when(F.size(cues) > 0, found).when(text.isNotNull(), F.array().cast("array<struct<cue:string,idx:int>>"))


def cues_in(text: Column) -> Column:
    return _all(text, NEGATION, 1)


def has_entity(text: Column, lexicon: Column) -> Column:
    return (F.size(drug_mentions(text, lexicon)) > 0) | text.rlike(DOSE) | text.rlike(NEGATION)


#: A word of each phrase of spoken punctuation, and texts of printable ASCII words between single spaces.
_SPOKEN_STEMS = sorted({p.split()[0] for p in SPOKEN_PUNCTUATION})
_TIDY = r"^[!-~]++(?: [!-~]++)*+$"


def strip_spoken_punctuation(text: Column) -> Column:
    """The text without spoken punctuation, its words between single spaces; a text without any is not taken apart."""
    some = reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in _SPOKEN_STEMS])
    stripped = F.trim(F.regexp_replace(F.regexp_replace(text, SPOKEN, " "), r"(?U)\s+", " "))
    return F.when(~some & text.rlike(_TIDY), text).otherwise(stripped)


def window(tokens: Column, centre: Column, radius: int = WINDOW) -> Column:
    """Tokens within ``radius`` of the place ``centre`` (from 0)."""
    first = F.greatest(centre - radius, F.lit(0))
    return F.slice(tokens, first + 1, F.greatest(centre + radius + 1 - first, F.lit(0)))


def aligned_centre(index: Column, reference: Column, hypothesis: Column) -> Column:
    """Where a reference place is expected in the hypothesis, in proportion; halves round to even."""
    n, m = F.size(reference), F.size(hypothesis)
    place = F.bround(index.cast("double") / (n - 1) * F.greatest(m - 1, F.lit(0)))
    return F.when(n <= 1, F.lit(0)).otherwise(place.cast("int"))


def excerpt_around(reference: Column, hypothesis: Column, index: Column, width: int = EXCERPT_WIDTH) -> tuple[Column, Column]:
    """Both sides around a reference place, without spoken punctuation; the judged word in double brackets."""
    ref, hyp = words(strip_spoken_punctuation(reference)), words(strip_spoken_punctuation(hypothesis))
    marked = F.transform(ref, lambda t, i: F.when(i == index, F.concat(F.lit("[["), t, F.lit("]]"))).otherwise(t))
    half = width // 2
    return F.array_join(window(marked, index, half), " "), F.array_join(window(hyp, aligned_centre(index, ref, hyp), half), " ")


def excerpt(marked: Column, width: int = EXCERPT_WIDTH) -> Column:
    """About ``width`` words around the first word that begins with an asterisk, else around the middle."""
    tokens = words(marked)
    n = F.size(tokens)
    starred = F.array_position(F.transform(tokens, lambda t: t.startswith("*")), F.lit(True)).cast("int")
    centre = F.when(starred > 0, starred - 1).otherwise(F.floor(n / 2).cast("int"))
    start = F.greatest(centre - width // 2, F.lit(0))
    return F.when(n <= width, marked).otherwise(F.array_join(F.slice(tokens, start + 1, F.lit(width + 1)), " "))


def unmark(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[\[(?:[\d,]+\|)?", ""), r"\]\]|\*", "")


def marked_reference(reference: Column, positions: Column) -> Column:
    """Each judged word numbered by the findings (from 1) that point at it: ``[[1,3|word]]``."""
    numbered = F.transform(positions, lambda p, k: F.struct(p.alias("at"), (k + 1).alias("number")))

    def token(t: Column, i: Column) -> Column:
        here = F.transform(F.filter(numbered, lambda p: p["at"] == i), lambda p: p["number"].cast("string"))
        return F.when(F.size(here) > 0, F.concat(F.lit("[["), F.array_join(here, ","), F.lit("|"), t, F.lit("]]"))).otherwise(t)

    return F.array_join(F.transform(words(reference), token), " ")


def drug_evidence(reference: Column, hypothesis: Column, lexicon: Column, normalise=lambda c: c) -> Column:
    """struct of the known drugs on both sides, marks taken off first."""
    return F.struct(drug_mentions(normalise(unmark(reference)), lexicon).alias("expected"), drug_mentions(normalise(unmark(hypothesis)), lexicon).alias("heard_known"))


def mark_diff(reference: Column, hypothesis: Column) -> Column:
    """struct<ref, hyp>: words outside the matching blocks of a Ratcliff-Obershelp diff in asterisks.

    The matching is recursive and has no counterpart among the built-in
    functions, so it is the one text function that runs in Python.
    """
    def starred(tokens: list[str], kept: set[int]) -> str:
        return " ".join(t if k in kept else f"*{t}*" for k, t in enumerate(tokens))

    def marked(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(left, right, strict=True):
            a, b = (a or "").split(), (b or "").split()
            blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
            rows.append((starred(a, {m.a + k for m in blocks for k in range(m.size)}), starred(b, {m.b + k for m in blocks for k in range(m.size)})))
        return pd.DataFrame(rows, columns=["ref", "hyp"])

    return F.pandas_udf(marked, "struct<ref:string,hyp:string>")(reference, hypothesis)


def member_key(path: Column) -> Column:
    """The last two parts of a path that ends in .wav: what a manifest and an archive agree on."""
    clean = F.regexp_replace(F.trim(path), "^/+", "")
    full = F.when(clean.endswith(".wav"), clean).otherwise(F.concat(clean, F.lit(".wav")))
    parts = F.split(full, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def split_name(name: Column) -> Column:
    """Distinct lower-cased parts of a product name: cut at ``; , and +``, not at a slash."""
    parts = F.transform(F.split(F.lower(name), r"\s*(?:;|,|\band\b|\+)\s*"), lambda p: F.trim(p))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda p: p != "")), F.array().cast("array<string>"))
