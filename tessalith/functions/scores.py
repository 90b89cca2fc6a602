"""Word error rate and the outcome of each drug, dose and negation, as column expressions.

Every outcome is an array with an entry per reference entity; counts and review
findings are both read off these arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessalith.functions import text as T

EDITS = 1
#: First private code point of a pair's vocabulary, and how many there are from there on without the surrogates.
FIRST_CODE, MOST_WORDS = 0x3400, 0x10FFFF - 0x3400 - 0x800
FINDING = "array<struct<kind:string,expected:string,heard:string,ref_index:int>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance of two arrays of words.

    Each distinct word of the pair becomes one code point; then the built-in
    string distance is the word distance, and no Python is needed.
    """

    def wide(place: Column) -> Column:
        code = place + (FIRST_CODE - 1)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(code >= 0xD800, code + 0x800).otherwise(code)), 8, "0")), "UTF-32")

    def distance(p: Column) -> Column:
        vocabulary = p["vocabulary"]
        coded = lambda tokens, code: F.array_join(F.transform(tokens, lambda w: code(F.array_position(vocabulary, w))), "")
        both = lambda code: F.levenshtein(coded(p["ref"], code), coded(p["hyp"], code))
        n = F.size(vocabulary)
        too_many = F.raise_error(F.lit(f"more than {MOST_WORDS} distinct words in a pair")).cast("int")
        return F.when(n < 256, both(F.chr)).when(n <= MOST_WORDS, both(wide)).otherwise(too_many)

    made = let(F.struct(reference.alias("ref"), hypothesis.alias("hyp"), F.array_distinct(F.concat(reference, hypothesis)).alias("vocabulary")), distance)
    return F.when(reference == hypothesis, 0).otherwise(made)


def _rate(ref: Column, hyp: Column) -> Column:
    return F.when(F.size(ref) > 0, word_edits(ref, hyp) / F.size(ref))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over reference words; null for a blank reference; may exceed 1."""
    both = F.struct(T.words(reference).alias("ref"), T.words(F.coalesce(hypothesis, F.lit(""))).alias("hyp"))
    return let(both, lambda p: _rate(p["ref"], p["hyp"]))


def _without(array: Column, place: Column) -> Column:
    """The array without its element at ``place`` (from 1); 0 removes nothing."""
    return F.filter(array, lambda _, i: i != place - 1)


def _first_true(array: Column, test) -> Column:
    return F.array_position(F.transform(array, test), F.lit(True))


def reference_parts(reference: Column, lexicon: Column) -> Column:
    """struct<words, drugs, doses, cues> of a reference: the same for all its hypotheses, so worked out once for each clip."""
    return F.struct(T.words(reference).alias("words"), T.drug_mentions(reference, lexicon).alias("drugs"), T.dose_pairs(reference).alias("doses"), T.negations(reference).alias("cues"))


def hypothesis_parts(reference: Column, parts: Column, hypothesis: Column, lexicon: Column) -> Column:
    """struct<words, drugs, doses> of a hypothesis; one that is its reference word for word is not taken apart again."""
    own = F.struct(T.words(hypothesis).alias("words"), T.drug_mentions(hypothesis, lexicon).alias("drugs"), T.dose_pairs(hypothesis).alias("doses"))
    return F.when(hypothesis == reference, F.struct(parts["words"].alias("words"), parts["drugs"].alias("drugs"), parts["doses"].alias("doses"))).otherwise(own)


def pair_of(reference: Column, hypothesis: Column, lexicon: Column) -> dict[str, Column]:
    """What the outcomes are worked out from, by the parts of both sides."""
    return {"ref": reference["words"], "hyp": hypothesis["words"], "drugs": reference["drugs"], "written": hypothesis["drugs"], "doses": reference["doses"], "hyp_doses": hypothesis["doses"], "cues": reference["cues"], "lexicon": lexicon}


Pair = dict[str, Column]


def drug_outcomes(p: Pair) -> Column:
    """array<struct<drug, ref_index, survived, heard>> per reference mention.

    A mention survives if any hypothesis word is within one edit.  Else it is
    substituted by the first known drug near its place that the reference
    never names (``heard``), or deleted (``heard`` is empty).
    """

    def outcome(m: Column) -> Column:
        index = F.greatest(F.array_position(p["ref"], m).cast("int") - 1, F.lit(0))
        survived = F.array_contains(p["hyp"], m) | F.exists(p["hyp"], lambda t: F.levenshtein(m, t) <= EDITS)
        near = T.window(p["hyp"], T.aligned_centre(index, p["ref"], p["hyp"]))
        others = F.filter(near, lambda t: F.array_contains(p["lexicon"], t) & ~F.array_contains(p["drugs"], t))
        made = lambda ok, heard: F.struct(m.alias("drug"), index.alias("ref_index"), F.lit(ok).alias("survived"), heard.alias("heard"))
        return F.when(survived, made(True, F.lit(""))).otherwise(made(False, F.coalesce(F.get(others, F.lit(0)), F.lit(""))))

    return F.transform(p["drugs"], outcome)


def false_positives(p: Pair) -> Column:
    """Hypothesis mentions that nothing in the reference accounts for, matched one for one in order.

    A written drug takes the nearest reference mention within one edit (and one
    spoken copy of it); failing that the first spoken word within one edit.
    """
    state = F.struct(p["drugs"].alias("open"), p["ref"].alias("spoken"), F.lit(0).alias("extra"))

    def step(s: Column, written: Column) -> Column:
        edits = F.transform(s["open"], lambda m: F.levenshtein(m, written))

        def taken(e: Column) -> Column:
            place = F.when(F.array_min(e) <= EDITS, F.array_position(e, F.array_min(e))).otherwise(F.lit(0))
            return F.struct(place.alias("place"), F.get(s["open"], (place - 1).cast("int")).alias("nearest"))

        def spent(t: Column) -> Column:
            heard = _first_true(s["spoken"], lambda w: F.levenshtein(w, written) <= EDITS)
            return F.struct(t["place"].alias("place"), F.when(t["place"] > 0, F.array_position(s["spoken"], t["nearest"])).otherwise(heard).alias("word"))

        def after(x: Column) -> Column:
            extra = F.when((x["place"] == 0) & (x["word"] == 0), 1).otherwise(0)
            return F.struct(_without(s["open"], x["place"]).alias("open"), _without(s["spoken"], x["word"]).alias("spoken"), (s["extra"] + extra).alias("extra"))

        return let(let(let(edits, taken), spent), after)

    # The same mentions in the same order match one for one.
    return F.when(p["written"] == p["drugs"], 0).otherwise(F.aggregate(p["written"], state, step, lambda s: s["extra"]))


def dose_outcomes(p: Pair) -> Column:
    """array<struct<value, unit, kind, heard_value, heard_unit>> per reference dose, greedily in order.

    Each takes from the hypothesis' doses an equal one (``correct``), else one
    with its unit (``value``), else one with its value (``unit``), else it is
    ``missing``.
    """
    entry = "array<struct<value:double,unit:string,kind:string,heard_value:double,heard_unit:string>>"
    state = F.struct(p["hyp_doses"].alias("open"), F.array().cast(entry).alias("done"))

    def step(s: Column, d: Column) -> Column:
        places = F.struct(
            _first_true(s["open"], lambda x: (x["value"] == d["value"]) & (x["unit"] == d["unit"])).alias("equal"),
            _first_true(s["open"], lambda x: x["unit"] == d["unit"]).alias("unit"),
            _first_true(s["open"], lambda x: x["value"] == d["value"]).alias("value"),
        )

        def after(x: Column) -> Column:
            place = F.when(x["equal"] > 0, x["equal"]).when(x["unit"] > 0, x["unit"]).otherwise(x["value"])
            kind = F.when(x["equal"] > 0, "correct").when(x["unit"] > 0, "value").when(x["value"] > 0, "unit").otherwise("missing")
            taken = F.get(s["open"], (place - 1).cast("int"))
            done = F.struct(d["value"].alias("value"), d["unit"].alias("unit"), kind.alias("kind"), taken["value"].alias("heard_value"), taken["unit"].alias("heard_unit"))
            return F.struct(_without(s["open"], place).alias("open"), F.concat(s["done"], F.array(done)).alias("done"))

        return let(places, after)

    # The same doses in the same order are equal one for one.
    equal = F.transform(p["doses"], lambda d: F.struct(d["value"].alias("value"), d["unit"].alias("unit"), F.lit("correct").alias("kind"), d["value"].alias("heard_value"), d["unit"].alias("heard_unit")))
    return F.when(p["doses"] == p["hyp_doses"], equal.cast(entry)).otherwise(F.aggregate(p["doses"], state, step, lambda s: s["done"]))


def negation_outcomes(p: Pair) -> Column:
    """array<struct<cue, idx, survived>>: a cue survives if it stands near its place."""

    def outcome(n: Column) -> Column:
        near = T.window(p["hyp"], T.aligned_centre(n["idx"], p["ref"], p["hyp"]))
        # A word of the window that is the cue stands free; else it may be a phrase or have marks around it.
        survived = F.array_contains(near, n["cue"]) | F.array_contains(T.cues_in(F.array_join(near, " ")), n["cue"])
        return F.struct(n["cue"].alias("cue"), n["idx"].alias("idx"), survived.alias("survived"))

    return F.transform(p["cues"], outcome)


def outcomes(p: Pair) -> Column:
    """struct of all outcomes of a pair of normalised texts; ``counts`` reads it."""
    return F.struct(drug_outcomes(p).alias("drugs"), dose_outcomes(p).alias("doses"), negation_outcomes(p).alias("cues"), F.size(p["written"]).alias("written"), false_positives(p).alias("extra"), _rate(p["ref"], p["hyp"]).alias("wer"))


# The sixteen scores, in order.
SCORES = (
    "wer", "wer_spoken_punct_removed", "drug_mentions", "drug_correct", "drug_substitution", "drug_deletion", "drug_hyp_mentions", "drug_false_positive",
    "doses", "dose_correct", "dose_value_error", "dose_unit_error", "dose_missing", "negation_cues", "negation_preserved", "negation_lost",
)


def counts(o: Column, stripped_rate: Column) -> dict[str, Column]:
    """The scores from ``outcomes`` and the word error rate without spoken punctuation; entities are judged with it left in."""
    n = lambda array, test: F.size(F.filter(array, test))
    kind = lambda k: lambda d: d["kind"] == k
    drugs, doses, cues = o["drugs"], o["doses"], o["cues"]
    made = (
        o["wer"], stripped_rate, F.size(drugs), n(drugs, lambda d: d["survived"]), n(drugs, lambda d: ~d["survived"] & (d["heard"] != "")), n(drugs, lambda d: ~d["survived"] & (d["heard"] == "")), o["written"], o["extra"],
        F.size(doses), *(n(doses, kind(k)) for k in ("correct", "value", "unit", "missing")), F.size(cues), n(cues, lambda c: c["survived"]), n(cues, lambda c: ~c["survived"]),
    )
    return dict(zip(SCORES, made, strict=True))


def short_number(value: Column) -> Column:
    """A double without trailing zeros, as in 500 and 2.5."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""))


# --- findings ----------------------------------------------------------------

COLLAPSE = 0.8
KINDS = ("DRUG-SUB", "DRUG-DEL", "DOSE-VAL", "DOSE-UNIT", "DOSE-MISS", "NEG-FLIP", "ASR-COLLAPSE")


def _finding(kind: Column, expected: Column, heard: Column, index: Column) -> Column:
    return F.struct(kind.alias("kind"), expected.alias("expected"), heard.alias("heard"), index.cast("int").alias("ref_index"))


def drug_findings(p: Pair) -> Column:
    lost = F.filter(drug_outcomes(p), lambda d: ~d["survived"])
    return F.transform(lost, lambda d: _finding(F.when(d["heard"] != "", "DRUG-SUB").otherwise("DRUG-DEL"), d["drug"], d["heard"], d["ref_index"]))


def dose_findings(p: Pair) -> Column:
    kinds = F.create_map(*[F.lit(x) for x in ("value", "DOSE-VAL", "unit", "DOSE-UNIT", "missing", "DOSE-MISS")])

    def finding(d: Column) -> Column:
        index = _first_true(p["ref"], lambda t: (t == d["value"].cast("string")) | (t == short_number(d["value"]))).cast("int")
        heard = F.coalesce(F.concat(short_number(d["heard_value"]), F.lit(" "), d["heard_unit"]), F.lit(""))
        return _finding(F.element_at(kinds, d["kind"]), F.concat(short_number(d["value"]), F.lit(" "), d["unit"]), heard, F.greatest(index - 1, F.lit(0)))

    return F.transform(F.filter(dose_outcomes(p), lambda d: d["kind"] != "correct"), finding)


def negation_findings(p: Pair) -> Column:
    lost = F.filter(negation_outcomes(p), lambda n: ~n["survived"])
    return F.transform(lost, lambda n: _finding(F.lit("NEG-FLIP"), n["cue"], F.lit(""), n["idx"]))


def collapse_finding(p: Pair) -> Column:
    head = lambda tokens: F.array_join(F.slice(tokens, 1, T.EXCERPT_WIDTH), " ")
    return _finding(F.lit("ASR-COLLAPSE"), head(p["ref"]), head(p["hyp"]), F.lit(0))


def findings(p: Pair) -> Column:
    """All findings of a pair in reading order; a collapsed transcript is one finding."""
    rows = F.concat(drug_findings(p), dose_findings(p), negation_findings(p)).cast(FINDING)
    keyed = F.array_sort(F.transform(rows, lambda f, i: F.struct(f["ref_index"].alias("at"), i.alias("nth"), f.alias("f"))))
    single = F.transform(keyed, lambda k: k["f"])
    return F.when(_rate(p["ref"], p["hyp"]) >= COLLAPSE, F.array(collapse_finding(p)).cast(FINDING)).otherwise(single)


def findings_of(reference: Column, hypothesis: Column, lexicon: Column) -> Column:
    """The findings of two normalised texts, spoken punctuation left out."""
    ref, hyp = T.strip_spoken_punctuation(reference), T.strip_spoken_punctuation(F.coalesce(hypothesis, F.lit("")))
    parts = reference_parts(ref, lexicon)
    return findings(pair_of(parts, hypothesis_parts(ref, parts, hyp, lexicon), lexicon))
