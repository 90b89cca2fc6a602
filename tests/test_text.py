import pytest
from pyspark.sql import functions as F

from tessalith.functions import text as T
from tessalith.functions.normalise import normalise, spoken_numbers
from tessalith.operators.scoring import lexicon_array

LEXICON = ["metformin", "warfarin", "insulin"]


@pytest.fixture(scope="module")
def of(spark):
    def value(column, **values):
        schema = ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'string' if not isinstance(v, int) else 'int'}" for k, v in values.items())
        return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]

    return value


def test_words_of_blank_texts(of):
    assert of(T.words(F.col("t")), t="") == [] and of(T.words(F.col("t")), t="  ") == []
    assert of(T.words(F.col("t")), t=" a  b\tc ") == ["a", "b", "c"]


def test_lexer_keeps_slashes_and_stops(of):
    assert of(T.lexed(F.col("t")), t="5 mg/dl, 2.5µg é-x") == ["5", "mg/dl", "2.5µg", "é", "x"]


def test_drug_mentions_are_whole_tokens_in_order(of):
    found = T.drug_mentions(F.col("t"), lexicon_array(LEXICON))
    assert of(found, t="warfarin then metformin and warfarin insulinoma") == ["warfarin", "metformin", "warfarin"]
    assert of(T.drug_mentions(F.col("t"), lexicon_array([])), t="warfarin") == []


@pytest.mark.parametrize(("text", "doses"), [
    ("take 500 mg twice", [(500.0, "mg")]), ("2.5ml and 10 cc", [(2.5, "ml"), (10.0, "ml")]), ("5 µg 3 ug 1 micrograms", [(5.0, "mcg"), (3.0, "mcg"), (1.0, "mcg")]),
    ("500 patients received mg doses", []), ("3 times daily", [(3.0, "times daily")]), ("120 mg/dl", [(120.0, "mg/dl")]), ("5 mgs x5 mg 5 mg/kg", []), ("1 tablet", [(1.0, "tablets")]), ("", []),
])
def test_dose_pairs(of, text, doses):
    assert [(d.value, d.unit) for d in of(T.dose_pairs(F.col("t")), t=text)] == doses


@pytest.mark.parametrize(("text", "cues"), [
    ("denies chest pain and no fever", [("denies", 0), ("no", 4)]), ("negative for malaria", [("negative for", 0)]), ("nothing notable", []),
    ("yes/no no", [("no", 1), ("no", 1)]), ("not, never without", [("not", 0), ("never", 1), ("without", 2)]), ("", []),
])
def test_negations_with_positions(of, text, cues):
    assert [(n.cue, n.idx) for n in of(T.negations(F.col("t")), t=text)] == cues


def test_spoken_punctuation(of):
    stripped = T.strip_spoken_punctuation(F.col("t"))
    assert of(stripped, t="no fever comma no cough full stop") == "no fever no cough"
    assert of(stripped, t="open bracket x close bracket commas semicolon") == "x commas"
    assert of(stripped, t="comma") == ""


@pytest.mark.parametrize(("index", "n", "m", "place"), [(0, 1, 5, 0), (1, 3, 6, 2), (3, 5, 3, 2), (1, 3, 4, 2), (1, 5, 3, 0), (2, 3, 0, 0)])
def test_aligned_centre_rounds_halves_to_even(of, index, n, m, place):
    assert of(T.aligned_centre(F.col("i"), F.array_repeat(F.lit("x"), n), F.array_repeat(F.lit("x"), m)), i=index) == place


def test_excerpts_and_marks(of):
    long = " ".join(f"w{k}" for k in range(30))
    ref, hyp = T.excerpt_around(F.col("r"), F.col("r"), F.lit(10))
    assert of(ref, r=long) == "w3 w4 w5 w6 w7 w8 w9 [[w10]] w11 w12 w13 w14 w15 w16 w17"
    assert of(hyp, r=long).split()[7] == "w10"
    assert of(T.unmark(F.col("t")), t="a [[1,3|metformin]] *b* [[c]]") == "a metformin b c"
    assert of(T.marked_reference(F.col("t"), F.col("p")), t="a b c", p=[1, -1, 1, 9]) == "a [[1,3|b]] c"
    assert of(T.excerpt(F.col("t")), t="short text") == "short text"
    assert of(T.excerpt(F.col("t")), t=long.replace("w20", "*w20*")).split() == [f"w{k}" if k != 20 else "*w20*" for k in range(13, 29)]


def test_mark_diff(of):
    both = of(T.mark_diff(F.col("r"), F.col("h")), r="the patient takes metformin daily", h="the patient takes metronidazole twice daily")
    assert both.ref == "the patient takes *metformin* daily" and both.hyp == "the patient takes *metronidazole* *twice* daily"


def test_names_and_keys(of):
    assert of(T.split_name(F.col("t")), t="Insulin Glargine; Lispro and Zinc + x/y, brandy") == ["insulin glargine", "lispro", "zinc", "x/y", "brandy"]
    assert of(T.split_name(F.col("t")), t="") == []
    assert of(T.member_key(F.col("t")), t="/set/test/session/name") == "session/name.wav" and of(T.member_key(F.col("t")), t="name.wav") == "name.wav"
    assert of(T.canonical_unit(F.col("t")), t="cc") == "ml" and of(T.canonical_unit(F.col("t")), t="zz") == "zz"


@pytest.mark.parametrize(("said", "written"), [
    ("five hundred mg", "500 mg"), ("two hundred and five point two", "205.2"), ("one two three", "1 2 3"), ("three times daily", "3 times daily"), ("five and six", "5 and 6"),
    ("twenty one thousand and five", "21005"), ("twenty ten", "20 10"), ("salt and pepper", "salt and pepper"), ("point of care", "point of care"), ("hundred", "hundred"),
])
def test_number_words(said, written):
    assert spoken_numbers(said) == written


def test_normaliser(of):
    assert of(normalise(F.col("t")), t="He doesn't take [noise] 1,000 MG (uh) of it, three times.") == "he does not take 1000 mg of it 3 times"
    assert of(normalise(F.col("t")), t="") == "" and of(normalise(F.coalesce(F.col("t"))), t="2.5 mg.") == "2.5 mg"
