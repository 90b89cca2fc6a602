"""Written cases: raw texts with several entities, and what plain loops (``tests/plain.py``) make of them; all of it fixed values."""

from __future__ import annotations

from typing import NamedTuple

LEXICON = ("amoxapine", "amoxicillin", "hydralazine", "hydroxyzine", "metformin", "metronidazole", "propranolol", "warfarin")


class Case(NamedTuple):
    """Raw texts, the same normalised by hand, the sixteen scores, and the findings (kind, expected, heard, place)."""

    clip_id: str
    reference: str
    hypothesis: str | None
    plain_reference: str
    plain_hypothesis: str | None
    scores: tuple
    findings: tuple


PAIRS = (
    Case(
        "two drugs",
        "Start metformin 500 mg and warfarin 5 mg daily.",
        "Start metformin 500 mg, and warfarin 5 mg daily",
        "start metformin 500 mg and warfarin 5 mg daily",
        "start metformin 500 mg and warfarin 5 mg daily",
        (0.0, 0.0, 2, 2, 0, 0, 2, 0, 2, 2, 0, 0, 0, 0, 0, 0),
        (),
    ),
    Case(
        "repeated drug",
        "Amoxicillin first, then amoxicillin again, and metformin.",
        "amoxicillin first then again and metformin and metformin",
        "amoxicillin 1st then amoxicillin again and metformin",
        "amoxicillin 1st then again and metformin and metformin",
        (0.428571429, 0.428571429, 3, 3, 0, 0, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0),
        (),
    ),
    Case(
        "near names",
        "Hydralazine 25 mg, hydroxyzine 10 mg at night",
        "Hydroxyzine 25 mg, hydroxyzine 10 mg at night",
        "hydralazine 25 mg hydroxyzine 10 mg at night",
        "hydroxyzine 25 mg hydroxyzine 10 mg at night",
        (0.125, 0.125, 2, 1, 0, 1, 2, 1, 2, 2, 0, 0, 0, 0, 0, 0),
        (("DRUG-DEL", "hydralazine", "", 0),),
    ),
    Case(
        "one letter off",
        "Warfarin and amoxapine were given",
        "Warfarine and amoxapin were given",
        "warfarin and amoxapine were given",
        "warfarine and amoxapin were given",
        (0.4, 0.4, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        (),
    ),
    Case(
        "substituted",
        "The patient takes propranolol every morning",
        "The patient takes metronidazole every morning",
        "the patient takes propranolol every morning",
        "the patient takes metronidazole every morning",
        (0.166666667, 0.166666667, 1, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0),
        (("DRUG-SUB", "propranolol", "metronidazole", 3),),
    ),
    Case(
        "swapped doses",
        "Give 500 mg twice, 250 mg at night, and 5 ml.",
        "Give 250 mg twice, 500 mg at night, and 5 mg.",
        "give 500 mg twice 250 mg at night and 5 ml",
        "give 250 mg twice 500 mg at night and 5 mg",
        (0.272727273, 0.272727273, 0, 0, 0, 0, 0, 0, 3, 2, 0, 1, 0, 0, 0, 0),
        (("DOSE-UNIT", "5 ml", "5 mg", 9),),
    ),
    Case(
        "greedy doses",
        "10 mg then 20 mg then 30 ml",
        "20 mg then 40 mg then 30 mg",
        "10 mg then 20 mg then 30 ml",
        "20 mg then 40 mg then 30 mg",
        (0.375, 0.375, 0, 0, 0, 0, 0, 0, 3, 0, 2, 1, 0, 0, 0, 0),
        (("DOSE-VAL", "10 mg", "20 mg", 0), ("DOSE-VAL", "20 mg", "40 mg", 3), ("DOSE-UNIT", "30 ml", "30 mg", 6),),
    ),
    Case(
        "several cues",
        "No fever, denies cough, negative for malaria, not vomiting",
        "Fever, denies cough, negative for malaria, vomiting",
        "no fever denies cough negative for malaria not vomiting",
        "fever denies cough negative for malaria vomiting",
        (0.222222222, 0.222222222, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 2, 2),
        (("NEG-FLIP", "no", "", 0), ("NEG-FLIP", "not", "", 7),),
    ),
    Case(
        "repeated cue",
        "No pain, no fever, no cough",
        "no pain fever cough",
        "no pain no fever no cough",
        "no pain fever cough",
        (0.333333333, 0.333333333, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3, 3, 0),
        (),
    ),
    Case(
        "aliases",
        "20 micrograms, 10 cc and 3 tablets",
        "20 µg, 10 millilitres and 3 tablet",
        "20 micrograms 10 cc and 3 tablets",
        "20 µg 10 milliliters and 3 tablet",
        (0.428571429, 0.428571429, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0),
        (),
    ),
    Case(
        "spoken marks",
        "Patient stable comma no fever full stop new line warfarin",
        "patient stable no fever warfarin",
        "patient stable comma no fever full stop new line warfarin",
        "patient stable no fever warfarin",
        (0.5, 0.0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0),
        (),
    ),
    Case(
        "number words",
        "Two hundred and fifty milligrams of metformin, twenty-five units",
        "250 mg of metformin, 25 units",
        "250 milligrams of metformin 25 units",
        "250 mg of metformin 25 units",
        (0.166666667, 0.166666667, 1, 1, 0, 0, 1, 0, 2, 2, 0, 0, 0, 0, 0, 0),
        (),
    ),
    Case(
        "invented",
        "No drugs were given today",
        "Warfarin and metformin were given today",
        "no drugs were given today",
        "warfarin and metformin were given today",
        (0.6, 0.6, 0, 0, 0, 0, 2, 2, 0, 0, 0, 0, 0, 1, 0, 1),
        (("NEG-FLIP", "no", "", 0),),
    ),
    Case(
        "collapsed",
        "The patient takes warfarin 5 mg daily without complaint",
        "quite other words",
        "the patient takes warfarin 5 mg daily without complaint",
        "quite other words",
        (1.0, 1.0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 1),
        (("ASR-COLLAPSE", "the patient takes warfarin 5 mg daily without complaint", "quite other words", 0),),
    ),
    Case(
        "empty answer",
        "No metformin 500 mg today",
        "",
        "no metformin 500 mg today",
        "",
        (1.0, 1.0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 1),
        (("ASR-COLLAPSE", "no metformin 500 mg today", "", 0),),
    ),
    Case(
        "null answer",
        "No metformin 500 mg today",
        None,
        "no metformin 500 mg today",
        None,
        (1.0, 1.0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 1, 1, 0, 1),
        (("ASR-COLLAPSE", "no metformin 500 mg today", "", 0),),
    ),
    Case(
        "empty reference",
        "",
        "warfarin 5 mg",
        "",
        "warfarin 5 mg",
        (None, None, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0),
        (),
    ),
    Case(
        "decimals",
        "2.5 mg of warfarin and 0.5 ml",
        "25 mg of warfarin and 0.5 ml",
        "2.5 mg of warfarin and 0.5 ml",
        "25 mg of warfarin and 0.5 ml",
        (0.142857143, 0.142857143, 1, 1, 0, 0, 1, 0, 2, 1, 1, 0, 0, 0, 0, 0),
        (("DOSE-VAL", "2.5 mg", "25 mg", 0),),
    ),
    Case(
        "far away",
        "No swelling was seen on the left arm and the right arm is in good shape as it was last week, warfarin",
        "swelling was seen on the left arm and the right arm is in good shape as it was last week no warfarin",
        "no swelling was seen on the left arm and the right arm is in good shape as it was last week warfarin",
        "swelling was seen on the left arm and the right arm is in good shape as it was last week no warfarin",
        (0.090909091, 0.090909091, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1),
        (("NEG-FLIP", "no", "", 0),),
    ),
)

#: Raw texts and what the normaliser makes of them.
TEXTS = (
    ("She won't take 2.5 mg, twice daily.", "she will not take 2.5 mg twice daily"),
    ("Two hundred and five milligrams", "205 milligrams"),
    ("Twenty-five units; THIRTY units", "25 units 30 units"),
    ("[noise] um, the pain's gone (laughs)", "the pain is gone"),
    ("Mr. Okoro can't walk", "mister okoro can not walk"),
    ("one thousand two hundred steps", "1200 steps"),
    ("BP 120/80, I've checked", "bp 120 80 i have checked"),
    ("1,250 mg", "1250 mg"),
    ("haemoglobin and oedema, anaemia", "hemoglobin and edema anemia"),
    ("the twenty first day, his third visit", "the 21st day his 3rd visit"),
    ("the second dose of the first drug", "the 2nd dose of the 1st drug"),
    ("double five, triple two", "55 222"),
    ("fifty percent of them", "50% of them"),
    ("twenty dollars", "$20"),
    ("in the nineties", "in the 90s"),
    ("three point five mg", "3.5 mg"),
    ("", ""),
)

#: Reference, hypothesis and the places of judged words; then the numbered reference, both sides of the diff, the excerpt, and the drugs of both sides.
MARKS = (
    ("take warfarin 5 mg now", "take metformin 5 mg now", [1, 1, -1]),
    ("no fever and no cough at all today", "no fever no cough at all", [0, 7, 99]),
    ("same words", "same words", []),
    ("amoxicillin alone", "", [0]),
)
MARKED = (
    ("take [[1,2|warfarin]] 5 mg now", "take warfarin 5 mg now", "take *warfarin* 5 mg now", "take *metformin* 5 mg now", "take *warfarin* 5 mg now", "warfarin", "metformin"),
    ("[[1|no]] fever and no cough at all [[2|today]]", "no fever and no cough at all today", "no fever *and* no cough at all *today*", "no fever no cough at all", "no fever *and* no cough at", "", ""),
    ("same words", "same words", "same words", "same words", "same words", "", ""),
    ("[[1|amoxicillin]] alone", "amoxicillin alone", "*amoxicillin* *alone*", "", "*amoxicillin* *alone*", "amoxicillin", ""),
)
