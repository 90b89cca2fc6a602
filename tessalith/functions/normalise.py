"""One English normaliser for references and hypotheses alike.

Lower case; bracketed asides and hesitations go; contractions are written out;
punctuation becomes space; number words become digits; British spellings that
clinical texts have become American.  Everything else is a chain of built-in
replacements; number words need a small parser and run as an Arrow function,
only on texts that have one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is replaced, in this order.
REPLACEMENTS = (
    (r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", ""), (r"\b(hmm|mm|mhm|mmm|uh|um)\b", ""), (r"\s+'", "'"),
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"),
    (r"\by'all\b", "you all"), (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"),
    (r"\bma'am\b", "madam"), (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"),
    (r"'ve\b", " have"), (r"'m\b", " am"), (r"(\d),(\d)", "$1$2"), (r"\.([^0-9]|$)", " $1"),
    (r"[^\w\s.%$¢€£µ]", " "), (r"(?<!\d)\.|\.(?!\d)", " "),
)

# English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12, "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60, "seventieth": 70, "eightieth": 80, "ninetieth": 90}
ORDINALS |= {f"{w}th": 13 + k for k, w in enumerate(UNITS[13:])}
REPEATS = {"double": 2, "triple": 3}
CURRENCIES = {"dollar": "$", "dollars": "$", "pounds sterling": "£", "euro": "€", "euros": "€", "cent": "¢", "cents": "¢"}
_VALUE = {w: k for k, w in enumerate(UNITS)} | {w: 10 * (k + 2) for k, w in enumerate(TENS)}
_PLURAL = {w[:-1] + "ies": v for w, v in _VALUE.items() if w.endswith("y")}
NUMBER_WORD = rf"\b({'|'.join([*_VALUE, *_PLURAL, *ORDINALS, 'hundred', *SCALES, 'percent', *CURRENCIES])})\b"

# British spellings that clinical texts have, by their American form.
SPELLINGS = {
    "anaemia": "anemia", "anaemic": "anemic", "anaesthesia": "anesthesia", "anaesthetic": "anesthetic", "caesarean": "cesarean", "centre": "center", "centres": "centers",
    "colour": "color", "coloured": "colored", "colours": "colors", "diarrhoea": "diarrhea", "dyspnoea": "dyspnea", "fibre": "fiber", "fibres": "fibers", "foetal": "fetal", "foetus": "fetus",
    "glycaemia": "glycemia", "gynaecology": "gynecology", "haematology": "hematology", "haematoma": "hematoma", "haematuria": "hematuria", "haemoglobin": "hemoglobin", "haemorrhage": "hemorrhage",
    "haemorrhoids": "hemorrhoids", "hyperglycaemia": "hyperglycemia", "hypoglycaemia": "hypoglycemia", "hypoxaemia": "hypoxemia", "ischaemia": "ischemia", "ischaemic": "ischemic", "kilometre": "kilometer",
    "kilometres": "kilometers", "labour": "labor", "leukaemia": "leukemia", "litre": "liter", "litres": "liters", "metre": "meter", "metres": "meters", "millilitre": "milliliter", "millilitres": "milliliters",
    "neighbour": "neighbor", "oedema": "edema", "oesophageal": "esophageal", "oesophagus": "esophagus", "oestrogen": "estrogen", "orthopaedic": "orthopedic", "paediatric": "pediatric", "paediatrics": "pediatrics",
    "programme": "program", "septicaemia": "septicemia", "tumour": "tumor", "tumours": "tumors", "uraemia": "uremia",
}
_BRITISH = rf"\b({'|'.join(sorted(SPELLINGS, key=len, reverse=True))})\b"


def _ending(n: int) -> str:
    return "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def spoken_numbers(text: str) -> str:
    """``text`` with runs of number words as digits: ``two hundred and five point two`` becomes ``205.2``.

    Ordinals, decades, ``double`` and ``triple``, percent and currencies go along:
    ``21st``, ``90s``, ``55``, ``50%``, ``$20``.
    """
    out: list[str] = []
    total = current = 0
    digits = ""  # behind a spoken point
    last = ""  # kind of the number word before: unit, ten, hundred, scale, point

    def flush(behind: str = "") -> None:
        nonlocal total, current, digits, last
        if last:
            out.append(f"{total + current}{'.' + digits if digits else ''}{behind}")
        total, current, digits, last = 0, 0, "", ""

    tokens = text.split()
    skip = 0
    for k, word in enumerate(tokens):
        if skip:
            skip -= 1
            continue
        following = tokens[k + 1] if k + 1 < len(tokens) else ""
        value = _VALUE.get(word)
        fits = lambda v: last in ("", "hundred", "scale") or (last == "ten" and 0 < v < 10)
        if value is not None and last == "point":
            digits += str(value)
        elif value is not None:
            if not fits(value):
                flush()
            current, last = current + value, "ten" if value >= 20 else "unit"
        elif word in ORDINALS:
            if not fits(ORDINALS[word]):
                flush()
            current, last = current + ORDINALS[word], "unit"
            flush(_ending(current))
        elif word in _PLURAL:
            if not fits(_PLURAL[word]):
                flush()
            current, last = current + _PLURAL[word], "ten"
            flush("s")
        elif word == "hundred" and last in ("unit", "ten") and current < 100:
            current, last = current * 100, "hundred"
        elif word in SCALES and last in ("unit", "ten", "hundred"):
            total, current, last = total + current * SCALES[word], 0, "scale"
        elif word == "and" and last in ("hundred", "scale") and following in _VALUE:
            continue
        elif word == "point" and last in ("unit", "ten", "hundred", "scale") and _VALUE.get(following, 10) < 10:
            last = "point"
        elif word in REPEATS and _VALUE.get(following, 10) < 10:
            flush()
            out.append(str(_VALUE[following]) * REPEATS[word])
            skip = 1
        else:
            flush()
            number = bool(out) and out[-1].replace(".", "", 1).isdigit()
            if word == "percent" and number:
                out[-1] += "%"
            elif word in CURRENCIES and number:
                out[-1] = CURRENCIES[word] + out[-1]
            else:
                out.append(word)
    flush()
    return " ".join(out)


def normalise(text: Column) -> Column:
    """The normalised text; null stays null."""
    out = F.lower(text)
    for pattern, by in REPLACEMENTS:
        out = F.regexp_replace(out, f"(?U){pattern}", by)
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))

    def parsed(x: pd.Series) -> pd.Series:
        american = lambda t: re.sub(_BRITISH, lambda m: SPELLINGS[m[0]], t)
        return x.map(lambda t: None if t is None else spoken_numbers(american(t)))

    # Only texts with a number word or a British spelling go to Python.
    spoken = F.pandas_udf(parsed, "string")(F.when(out.rlike(NUMBER_WORD) | out.rlike(_BRITISH), out))
    return F.coalesce(spoken, out)
