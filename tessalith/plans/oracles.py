"""DuckDB SQL that gives the rows of the registered queries by other means.

Scores are worked out entity by entity over unnested tokens.  The fixture's
transcripts hold at most one dose and one drug per reference, which the SQL for
doses and invented drugs relies on.
"""

from __future__ import annotations

from tessalith.functions.text import SPOKEN_PUNCTUATION
from tessalith.functions.scores import SCORES
from tessalith.operators.scoring import ERRORS, POISSON
from tessalith.plans import cases
from tessalith.plans.fixture import ANSWERS_SQL, CLIPS_SQL, DRUGS
from tessalith.plans.queries import ALLOCATION, SECRET

LEXICON = "[" + ", ".join(f"'{d}'" for d in DRUGS) + "]"
_SPOKEN = "|".join(SPOKEN_PUNCTUATION)


def _row(values: tuple) -> str:
    return "(" + ", ".join("NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + ")"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def lexed(text: str) -> str:
    return f"regexp_extract_all({text}, '[\\w/.]+')"


def stripped(text: str) -> str:
    # RE2 has no look-around: blanks are doubled, so that each phrase has its own on both sides.
    return f"trim(regexp_replace(regexp_replace(regexp_replace(concat(' ', {text}, ' '), '\\s+', '  ', 'g'), ' ({_SPOKEN}) ', ' ', 'g'), '\\s+', ' ', 'g'))"


def wer(a: str, b: str, vocabulary: str) -> str:
    """Levenshtein over one ASCII character per distinct word of the pair (few words a pair); ``vocabulary`` is a column."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(32 + list_position({vocabulary}, w))), '')"
    return f"CASE WHEN {a} = {b} AND len({a}) > 0 THEN 0.0::DOUBLE WHEN len({a}) > 0 THEN levenshtein({code(a)}, {code(b)}) / len({a})::DOUBLE END"


def centre(index: str, n: str, m: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 ELSE round_even({index} / ({n} - 1)::DOUBLE * greatest({m} - 1, 0), 0)::INT END"


def window(tokens: str, at: str) -> str:
    return f"list_slice({tokens}, greatest({at} - 5, 0) + 1, {at} + 6)"


SCORED = f"""{ANSWERS_SQL}, split AS (
  SELECT clip_id, provider, accent, tier, domain, duration, latency_ms, cost_usd, audio_seconds, reference, hypothesis,
    {words("reference")} AS rw, {words("hypothesis")} AS hw, {words(stripped("reference"))} AS rs, {words(stripped("hypothesis"))} AS hs,
    list_filter({lexed("reference")}, lambda t: list_contains({LEXICON}, t)) AS rm, list_filter({lexed("hypothesis")}, lambda t: list_contains({LEXICON}, t)) AS hm,
    regexp_extract(reference, '(?:^| )(\\d+) (mg|ml|units|tablets|drops)(?: |$)', ['value', 'unit']) AS rd,
    regexp_extract(hypothesis, '(?:^| )(\\d+) (mg|ml|units|tablets|drops)(?: |$)', ['value', 'unit']) AS hd,
    list_filter({lexed("reference")}, lambda t: t IN ('denies', 'denied', 'without', 'never', 'not', 'no')) AS rn
  FROM answers
), vocabulary AS (
  SELECT *, list_distinct(list_concat(rw, hw)) AS v, list_distinct(list_concat(rs, hs)) AS vs FROM split
), tokens AS MATERIALIZED (
  SELECT *, {wer("rw", "hw", "v")} AS wer, {wer("rs", "hs", "vs")} AS wer_spoken_punct_removed FROM vocabulary
), drugs AS MATERIALIZED (
  SELECT provider, clip_id, m, ref_index, survived, CASE WHEN survived OR len(others) = 0 THEN '' ELSE others[1] END AS heard
  FROM (
    SELECT provider, clip_id, m, list_position(rw, m) - 1 AS ref_index, len(list_filter(hw, lambda t: levenshtein(m, t) <= 1)) > 0 AS survived,
      list_filter({window("hw", centre("(list_position(rw, m) - 1)", "len(rw)", "len(hw)"))}, lambda t: list_contains({LEXICON}, t) AND NOT list_contains(rm, t)) AS others
    FROM (SELECT *, unnest(rm) AS m FROM tokens)
  )
), drug_sums AS (
  SELECT provider, clip_id, count(*) AS mentions, count_if(survived) AS correct, count_if(NOT survived AND heard <> '') AS substitution, count_if(NOT survived AND heard = '') AS deletion FROM drugs GROUP BY ALL
), cues AS MATERIALIZED (
  SELECT provider, clip_id, c, idx, list_contains(regexp_extract_all(concat(' ', array_to_string(near, '  '), ' '), ' (denies|denied|without|never|not|no) ', 1), c) AS survived
  FROM (
    SELECT provider, clip_id, c, list_position({lexed("reference")}, c) - 1 AS idx, {window("hw", centre(f"(list_position({lexed('reference')}, c) - 1)", "len(rw)", "len(hw)"))} AS near
    FROM (SELECT *, unnest(rn) AS c FROM tokens)
  )
), cue_sums AS (
  SELECT provider, clip_id, count(*) AS cues, count_if(survived) AS preserved, count_if(NOT survived) AS lost FROM cues GROUP BY ALL
), scored AS MATERIALIZED (
  SELECT t.clip_id, t.provider, t.accent, t.tier, t.domain, t.duration, latency_ms, cost_usd, audio_seconds, rd, hd,
    wer, wer_spoken_punct_removed,
    coalesce(mentions, 0) AS drug_mentions, coalesce(correct, 0) AS drug_correct, coalesce(substitution, 0) AS drug_substitution, coalesce(deletion, 0) AS drug_deletion,
    len(hm) AS drug_hyp_mentions, len(hm) - least(1, len(list_filter(hm, lambda h: len(list_filter(rm, lambda m: levenshtein(m, h) <= 1)) > 0))) AS drug_false_positive,
    (rd.value <> '')::INT AS doses,
    (rd.value <> '' AND rd = hd)::INT AS dose_correct,
    (rd.value <> '' AND rd.unit = hd.unit AND rd.value <> hd.value)::INT AS dose_value_error,
    (rd.value <> '' AND rd.unit <> hd.unit AND rd.value = hd.value)::INT AS dose_unit_error,
    (rd.value <> '' AND rd.unit <> hd.unit AND rd.value <> hd.value)::INT AS dose_missing,
    coalesce(cues, 0) AS negation_cues, coalesce(preserved, 0) AS negation_preserved, coalesce(lost, 0) AS negation_lost
  FROM tokens t LEFT JOIN drug_sums USING (provider, clip_id) LEFT JOIN cue_sums USING (provider, clip_id)
)"""

_COUNTS = ("drug_mentions", "drug_correct", "drug_substitution", "drug_deletion", "drug_hyp_mentions", "drug_false_positive", "doses", "dose_correct", "dose_value_error", "dose_unit_error", "dose_missing", "negation_cues", "negation_preserved", "negation_lost")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) END"


_RECALL = ratio("sum(drug_correct)", "sum(drug_mentions)")
_PRECISION = ratio("sum(drug_hyp_mentions) - sum(drug_false_positive)", "sum(drug_hyp_mentions)")
_HEADLINE = f"""count(*) AS clips, round(avg(wer), 9) AS wer, round(avg(wer_spoken_punct_removed), 9) AS wer_spoken_punct_removed,
  round(CASE WHEN avg(wer) <> 0 THEN (avg(wer) - avg(wer_spoken_punct_removed)) / avg(wer) END, 9) AS wer_spoken_punct_share,
  sum(drug_mentions)::BIGINT AS drug_mentions, round({_RECALL}, 9) AS drug_accuracy, sum(drug_hyp_mentions)::BIGINT AS drug_hyp_mentions, sum(drug_false_positive)::BIGINT AS drug_false_positives,
  round({_PRECISION}, 9) AS drug_precision, round(CASE WHEN ({_PRECISION}) + ({_RECALL}) > 0 THEN 2 * ({_PRECISION}) * ({_RECALL}) / (({_PRECISION}) + ({_RECALL})) END, 9) AS drug_f1,
  sum(drug_substitution)::BIGINT AS drug_substitutions, sum(doses)::BIGINT AS doses, round({ratio("sum(dose_correct) + sum(dose_unit_error)", "sum(doses)")}, 9) AS dose_value_accuracy,
  sum(dose_value_error)::BIGINT AS dose_value_errors, sum(dose_unit_error)::BIGINT AS dose_unit_errors, sum(negation_cues)::BIGINT AS negation_cues,
  round({ratio("sum(negation_preserved)", "sum(negation_cues)")}, 9) AS negation_preservation"""
_COST = "round(sum(cost_usd) / (sum(audio_seconds) / 3600), 9) AS cost_per_audio_hour, median(latency_ms) AS median_latency_ms"

FOUND = f"""{SCORED}, flat AS (
  SELECT clip_id, provider, accent, tier, domain, {stripped("reference")} AS reference, {stripped("hypothesis")} AS hypothesis, wer_spoken_punct_removed AS w, rd, hd FROM tokens
), found AS MATERIALIZED (
  SELECT clip_id, provider, accent, tier, domain, 'ASR-COLLAPSE' AS kind, array_to_string(list_slice({words("reference")}, 1, 15), ' ') AS expected, array_to_string(list_slice({words("hypothesis")}, 1, 15), ' ') AS heard, 0 AS ref_index, 0 AS family FROM flat WHERE w >= 0.8
  UNION ALL SELECT clip_id, provider, accent, tier, domain, CASE WHEN d.heard <> '' THEN 'DRUG-SUB' ELSE 'DRUG-DEL' END, d.m, d.heard, d.ref_index, 1 FROM flat JOIN drugs d USING (provider, clip_id) WHERE w < 0.8 AND NOT d.survived
  UNION ALL SELECT clip_id, provider, accent, tier, domain, CASE WHEN rd.unit = hd.unit THEN 'DOSE-VAL' WHEN rd.value = hd.value THEN 'DOSE-UNIT' ELSE 'DOSE-MISS' END, concat(rd.value, ' ', rd.unit),
    CASE WHEN rd.unit = hd.unit OR rd.value = hd.value THEN concat(hd.value, ' ', hd.unit) ELSE '' END, list_position({words("reference")}, rd.value) - 1, 2 FROM flat WHERE w < 0.8 AND rd.value <> '' AND rd <> hd
  UNION ALL SELECT clip_id, provider, accent, tier, domain, 'NEG-FLIP', c.c, '', c.idx, 3 FROM flat JOIN cues c USING (provider, clip_id) WHERE w < 0.8 AND NOT c.survived
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY provider, clip_id ORDER BY ref_index, family) - 1 AS position FROM found
), counted AS (
  SELECT kind, count(*) AS total FROM found GROUP BY kind
), shared AS (
  SELECT *, least(total, 150 // count(*) OVER ()) AS share, 150 - sum(least(total, 150 // (SELECT count(*) FROM counted))) OVER () AS spare FROM counted
), quota AS (
  SELECT kind, total, share + greatest(0, least(total - share, spare - coalesce(sum(total - share) OVER (ORDER BY total DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM shared
), picked AS (
  SELECT placed.*, total / quota::DOUBLE AS weight, quota,
    row_number() OVER (PARTITION BY kind ORDER BY md5(concat_ws('|', provider, clip_id, kind, ref_index, position)), provider, clip_id) AS nth FROM placed JOIN quota USING (kind)
)"""

MANIFEST = f"""{CLIPS_SQL}, manifest AS (
  SELECT clip_id, accent, domain, duration, speaker_id, drug, reference,
    len(list_filter({lexed("reference")}, lambda t: list_contains({LEXICON}, t))) > 0 AS has_drug, array_to_string(list_filter({lexed("reference")}, lambda t: list_contains({LEXICON}, t)), '|') AS drug_terms,
    regexp_extract(reference, ' (\\d+) (mg|ml|units|tablets) ', ['value', 'unit']) AS d, regexp_matches(reference, ' (denies|no) ') AS has_negation FROM clips
), full_manifest AS (
  SELECT *, d.value <> '' AS has_dose, concat(d.value, '.0 ', d.unit) AS dose_strings, has_drug OR d.value <> '' OR has_negation AS has_entity FROM manifest
), pool AS (
  SELECT full_manifest.*, tier FROM full_manifest JOIN tiers USING (accent) WHERE duration BETWEEN 3 AND 30 AND tier IS NOT NULL
), targets AS (
  SELECT * FROM (VALUES {", ".join(f"('{t}', {round(n * 0.8)}, {n - round(n * 0.8)})" for t, n in ALLOCATION.items())}) x(tier, clinical, general)
), queued AS (
  SELECT *, row_number() OVER (PARTITION BY tier, domain, accent ORDER BY has_entity DESC, md5(CAST(clip_id AS VARCHAR)), clip_id) AS n FROM pool
), first_dealt AS (
  SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n, accent) AS dealt FROM queued WHERE domain = 'clinical' AND n <= 40
), first_drawn AS (
  SELECT f.* FROM first_dealt f JOIN targets t USING (tier) WHERE dealt <= t.clinical
), taken AS (
  SELECT tier, accent, count(*) AS taken FROM first_drawn GROUP BY ALL
), second_dealt AS (
  SELECT q.*, row_number() OVER (PARTITION BY q.tier ORDER BY n, q.accent) AS dealt FROM queued q LEFT JOIN taken k ON k.tier = q.tier AND k.accent = q.accent WHERE domain = 'general' AND n <= 40 - coalesce(taken, 0)
), drawn AS (
  SELECT * FROM first_drawn UNION ALL SELECT s.* FROM second_dealt s JOIN targets t USING (tier) WHERE dealt <= t.general
)"""

CACHE = f"""{ANSWERS_SQL}, cache AS (
  SELECT clip_id, provider, hypothesis, latency_ms, audio_seconds, cost_usd FROM answers WHERE NOT (provider = 'p2' AND clip_id % 7 = 0)
)"""

_BINOMIAL = "least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only)::BIGINT + 1), lambda k: factorial(discordant::INT)::DOUBLE / (factorial(k::INT)::DOUBLE * factorial((discordant - k)::INT)::DOUBLE))) / pow(2, discordant))"
_Z = "sqrt(statistic / 2)"
_PI = "3.141592653589793"
_SERIES = f"1 - 2 / sqrt({_PI}) * list_sum(list_transform(range(0, 61), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest({_Z}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))"
_DEEP = f"exp(-statistic / 2) / sqrt({_PI}) / list_reduce(list_concat([{_Z}], list_transform(range(1, 81), lambda k: (81 - k)::DOUBLE)), lambda d, k: {_Z} + k / 2.0 / d)"

_PAIRED = f"""{SCORED}, success AS (
  SELECT provider, clip_id, 'drug' AS metric, (drug_correct = drug_mentions)::INT AS ok FROM scored WHERE drug_mentions > 0
  UNION ALL SELECT provider, clip_id, 'dose', (dose_correct + dose_unit_error = doses)::INT FROM scored WHERE doses > 0
  UNION ALL SELECT provider, clip_id, 'negation', (negation_preserved = negation_cues)::INT FROM scored WHERE negation_cues > 0
), pairs AS (
  SELECT metric, a.provider AS provider_a, b.provider AS provider_b, count(*) AS n_pairs, sum(a.ok)::BIGINT AS a_clips_correct, sum(b.ok)::BIGINT AS b_clips_correct,
    count_if(a.ok = 1 AND b.ok = 0) AS a_only, count_if(b.ok = 1 AND a.ok = 0) AS b_only
  FROM success a JOIN success b USING (metric, clip_id) WHERE a.provider < b.provider GROUP BY ALL
), tested AS (
  SELECT *, a_only + b_only AS discordant, CASE WHEN a_only + b_only > 0 THEN pow(greatest(abs(a_only - b_only) - 1, 0), 2) / (a_only + b_only)::DOUBLE ELSE 0 END AS statistic FROM pairs
)
SELECT metric, provider_a, provider_b, n_pairs, a_clips_correct, b_clips_correct, a_only, b_only, discordant, round(statistic, 8) AS statistic,
  round(CASE WHEN discordant < 25 THEN {_BINOMIAL} WHEN {_Z} < 2.5 THEN {_SERIES} ELSE {_DEEP} END, 8) AS p_value, CASE WHEN discordant < 25 THEN 'exact' ELSE 'chi2' END AS test
FROM tested"""

_BREAKDOWNS = " UNION ALL ".join([f"SELECT provider, 'all' AS breakdown, CAST(NULL AS VARCHAR) AS level, {_HEADLINE} FROM scored GROUP BY provider", *(f"SELECT provider, '{b}', {b}, {_HEADLINE} FROM scored GROUP BY provider, {b}" for b in ("tier", "domain", "accent"))])
_FAILED = " OR ".join(f"{c} > 0" for c in ("wer", *ERRORS))
_BAND = "CASE WHEN drug_substitution > 0 THEN {} WHEN dose_value_error > 0 THEN {} WHEN negation_lost > 0 THEN {} ELSE {} END"
_SHARES = "avg((domain = 'clinical')::INT) AS clinical_share, avg(has_drug::INT) AS has_drug_share, avg(has_dose::INT) AS has_dose_share, avg(has_negation::INT) AS has_negation_share, avg(has_entity::INT) AS has_entity_share, sum(duration) / 60 AS minutes"
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("clinical_share", "has_drug_share", "has_dose_share", "has_negation_share", "has_entity_share", "minutes"))

_EXCERPT = f"""SELECT provider, clip_id, array_to_string(list_slice(list_transform(rs, lambda w, i: CASE WHEN i = 4 THEN concat('[[', w, ']]') ELSE w END), 1, 11), ' ') AS ref_excerpt,
  array_to_string(list_slice(hs, greatest({centre("3", "len(rs)", "len(hs)")} - 7, 0) + 1, {centre("3", "len(rs)", "len(hs)")} + 8), ' ') AS hyp_excerpt FROM tokens"""

#: How a person might have filled the sheet.
_FILLED = """CASE WHEN (finding_id + {t}) % 5 = 0 THEN 'NO-ERROR' WHEN (finding_id + {t}) % 5 = 1 THEN 'BENIGN' WHEN (finding_id + {t}) % 7 = 2 THEN '' ELSE kind END AS failure_code,
    concat('S', finding_id % 3 + 1) AS severity, CASE WHEN (finding_id + {t}) % 4 = 0 THEN 'heard "twice", clearly' ELSE '' END AS note"""

_REVIEW = f"""{FOUND}, sheet AS (
  SELECT row_number() OVER (ORDER BY kind, clip_id, provider, ref_index, position) AS finding_id, picked.* FROM picked WHERE nth <= quota
), shown AS (
  SELECT s.*, {words("t.reference")} AS r, {words("f.hypothesis")} AS h, rs, hs FROM sheet s JOIN tokens t USING (provider, clip_id) JOIN flat f USING (provider, clip_id)
), review AS MATERIALIZED (
SELECT finding_id, 'detector' AS source, clip_id, provider, accent, tier, domain, kind, expected, heard, round(weight, 4) AS weight,
  array_to_string(list_slice(list_transform(rs, lambda w, i: CASE WHEN i = ref_index + 1 THEN concat('[[', w, ']]') ELSE w END), greatest(ref_index - 7, 0) + 1, ref_index + 8), ' ') AS ref_excerpt,
  array_to_string(list_slice(hs, greatest({centre("ref_index", "len(rs)", "len(hs)")} - 7, 0) + 1, {centre("ref_index", "len(rs)", "len(hs)")} + 8), ' ') AS hyp_excerpt,
  concat(kind, ' candidate') AS auto_flag, '' AS needs_listen, '' AS failure_code, '' AS severity, '' AS note
FROM shown
), filled AS (
  SELECT * REPLACE ({_FILLED.format(t=0)}), weight AS w, 'detector' AS who FROM review
), added AS (
  SELECT finding_id + 1000 AS finding_id, 'human' AS source, clip_id, provider, accent, tier, domain, 'HUMAN' AS kind, 'TERM-CORRUPT' AS failure_code, 'S2' AS severity FROM review WHERE finding_id % 20 = 0
), labelled AS (
  SELECT finding_id, source, clip_id, provider, tier, kind, weight, failure_code, severity, note FROM filled
  UNION ALL SELECT finding_id, source, clip_id, provider, tier, kind, CAST(NULL AS DOUBLE), failure_code, severity, CASE WHEN (finding_id - 1000) % 4 = 0 THEN '' ELSE '' END FROM added
)"""
_DONE = "failure_code <> '' AND severity <> ''"

_RATE = f"""{CLIPS_SQL}, rates AS (
  SELECT clip_id, duration, len({words("reference")}) AS n, len({words("reference")}) / duration AS rate FROM clips
), bounds AS (
  SELECT median(rate) * 0.25 AS low, median(rate) * 4 AS high FROM rates
)
SELECT clip_id, duration, round(low, 9) AS low, round(high, 9) AS high, printf('%.2f words per second (%d words in %.1fs), outside %.2f to %.2f', rate, n, duration, low, high) AS reason
FROM rates, bounds WHERE NOT rate BETWEEN low AND high"""

_NAME_PARTS = "list_filter(list_transform(string_split_regex(lower({}), '\\s*(?:;|,|\\band\\b|\\+)\\s*'), lambda x: trim(x)), lambda x: x <> '')"
_TERMS = f"""WITH raw AS (
  SELECT concat(p_name, ' and ', lower(p_type)) AS generic_name, p_brand AS brand_name, lower(p_name) AS ingredient FROM part
), generic AS (
  SELECT DISTINCT unnest(list_concat({_NAME_PARTS.format("generic_name")}, {_NAME_PARTS.format("ingredient")})) AS term FROM raw
), brand AS (
  SELECT DISTINCT unnest({_NAME_PARTS.format("brand_name")}) AS term FROM raw
)"""
_BLOCKED = "('sodium', 'tablet', 'water', 'film', 'powder', 'gel', 'strength', 'protein', 'delayed')"
_COMPONENTS = f"SELECT DISTINCT term FROM (SELECT unnest(string_split(term, ' ')) AS term FROM generic WHERE contains(term, ' ')) WHERE regexp_full_match(term, '[a-z]{{4,}}') AND term NOT IN {_BLOCKED}"
_TRUSTED = f"SELECT term FROM generic UNION SELECT term FROM (VALUES {', '.join(f'({chr(39)}{d}{chr(39)})' for d in DRUGS)}) v(term) UNION (SELECT term FROM ({_COMPONENTS}) WHERE term NOT IN ('steel', 'copper'))"

ORACLES: dict[str, str] = {
    "drug_mentions": f"WITH {CLIPS_SQL} SELECT clip_id, nth - 1 AS nth, m[nth] AS drug FROM (SELECT clip_id, m, unnest(range(1, len(m) + 1)) AS nth FROM (SELECT clip_id, list_filter({lexed('reference')}, lambda t: list_contains({LEXICON}, t)) AS m FROM clips))",
    "dose_pairs": f"WITH {CLIPS_SQL} SELECT clip_id, d.value::DOUBLE AS value, d.unit FROM (SELECT clip_id, regexp_extract(reference, ' (\\d+) (mg|ml|units|tablets) ', ['value', 'unit']) AS d FROM clips) WHERE d.value <> ''",
    "negation_positions": f"WITH {CLIPS_SQL} SELECT clip_id, w[i] AS cue, i - 1 AS idx FROM (SELECT clip_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT clip_id, {words('reference')} AS w FROM clips)) WHERE w[i] IN ('denies', 'denied', 'without', 'never', 'not', 'no')",
    "entity_flags": f"WITH {MANIFEST} SELECT clip_id, has_drug, drug_terms, has_dose, dose_strings, has_negation, has_entity FROM full_manifest",
    "stripped_texts": f"WITH {ANSWERS_SQL} SELECT provider, clip_id, {stripped('hypothesis')} AS stripped FROM answers WHERE tier IS NOT NULL",
    "excerpts": f"WITH {SCORED} {_EXCERPT} WHERE tier IS NOT NULL",
    "clip_scores": f"WITH {SCORED} SELECT clip_id, provider, accent, tier, domain, round(wer, 9) AS wer, round(wer_spoken_punct_removed, 9) AS wer_spoken_punct_removed, {', '.join(_COUNTS)} FROM scored WHERE tier IS NOT NULL",
    "wer_by_provider": f"WITH {SCORED} SELECT provider, count(*) AS clips, round(avg(wer), 9) AS wer FROM scored GROUP BY provider",
    "headline": f"WITH {SCORED} SELECT provider, {_HEADLINE}, {_COST} FROM scored GROUP BY provider",
    "summary_by_tier": f"WITH {SCORED} SELECT provider, tier, {_HEADLINE} FROM scored GROUP BY provider, tier",
    "summary_by_domain": f"WITH {SCORED} SELECT provider, domain, {_HEADLINE} FROM scored GROUP BY provider, domain",
    "summary_by_accent": f"WITH {SCORED} SELECT provider, accent, {_HEADLINE} FROM scored GROUP BY provider, accent",
    "summary_all": f"WITH {SCORED} {_BREAKDOWNS}",
    "cost_latency": f"WITH {ANSWERS_SQL} SELECT provider, {_COST} FROM answers GROUP BY provider",
    "significance": f"WITH {_PAIRED}",
    "collapse_rates": f"WITH {SCORED} SELECT provider, tier, count(wer) AS clips, round(avg((wer >= 0.8)::INT), 9) AS collapse_rate, round(avg((wer_spoken_punct_removed >= 0.8)::INT), 9) AS collapse_rate_stripped FROM scored GROUP BY ALL",
    "drug_recall_intervals": f"WITH {SCORED}, s AS (SELECT provider, sum(drug_correct)::BIGINT AS correct, sum(drug_mentions)::BIGINT AS mentions, 1.959963984540054::DOUBLE AS z FROM scored GROUP BY provider), p AS (SELECT *, correct / mentions::DOUBLE AS p FROM s) SELECT provider, correct, mentions, round((p + z * z / 2 / mentions - z * sqrt(p * (1 - p) / mentions + z * z / 4 / mentions / mentions)) / (1 + z * z / mentions), 9) AS low, round((p + z * z / 2 / mentions + z * sqrt(p * (1 - p) / mentions + z * z / 4 / mentions / mentions)) / (1 + z * z / mentions), 9) AS high FROM p",
    "findings": f"WITH {FOUND} SELECT clip_id, provider, accent, tier, domain, kind, expected, heard, ref_index FROM found",
    "findings_by_kind": f"WITH {FOUND} SELECT provider, kind, count(*) AS n FROM found GROUP BY ALL",
    "findings_sample": f"WITH {FOUND} SELECT provider, clip_id, kind, expected, heard, ref_index, round(weight, 9) AS weight FROM picked WHERE nth <= quota",
    "review_sheet": f"WITH {_REVIEW} SELECT * FROM review",
    "review_cards": f"""WITH {_REVIEW}, c AS (SELECT *, row_number() OVER (PARTITION BY clip_id, provider ORDER BY finding_id) AS position FROM review)
SELECT clip_id, provider, arg_min(accent, finding_id) AS accent, arg_min(tier, finding_id) AS tier, arg_min(domain, finding_id) AS domain, count(*) AS n,
  string_agg(concat_ws('|', position, finding_id, kind, expected, heard, ref_excerpt, hyp_excerpt), ';' ORDER BY position) AS findings FROM c GROUP BY clip_id, provider""",
    "sheet_labels": f"WITH {_REVIEW} SELECT finding_id, source, clip_id, provider, kind, weight, failure_code, severity, note FROM labelled",
    "taxonomy_summary": f"WITH {_REVIEW} SELECT provider, tier, count(*) AS rows, count_if({_DONE}) AS done, round(sum(coalesce(weight, 1)), 3) AS findings, round(coalesce(sum(coalesce(weight, 1)) FILTER (WHERE severity = 'S1'), 0), 3) AS worst FROM labelled GROUP BY provider, tier",
    "label_distribution": f"WITH {_REVIEW} SELECT provider, tier, failure_code, severity, count(*) AS rows, round(sum(coalesce(weight, 1)), 3) AS findings FROM labelled WHERE {_DONE} GROUP BY ALL",
    "missed_by_detector": f"WITH {_REVIEW}, c AS (SELECT provider, count_if(source <> 'human' AND {_DONE} AND failure_code <> 'NO-ERROR') AS found, count_if(source = 'human' AND {_DONE} AND failure_code <> 'NO-ERROR') AS missed FROM labelled GROUP BY provider) SELECT *, round(missed / (found + missed)::DOUBLE, 9) AS missed_rate FROM c",
    "rater_agreement": f"WITH {_REVIEW}, a AS (SELECT finding_id, failure_code, severity FROM filled WHERE {_DONE}), second AS (SELECT * REPLACE ({_FILLED.format(t=1)}) FROM review), b AS (SELECT finding_id, failure_code, severity FROM second WHERE {_DONE}) SELECT count(*) AS findings, round(avg((a.failure_code = b.failure_code)::INT), 9) AS code_agreement, round(avg((a.severity = b.severity)::INT), 9) AS severity_agreement FROM a JOIN b USING (finding_id)",
    "sheet_coverage": f"WITH {_REVIEW}, n AS (SELECT kind, count(*) AS found FROM found GROUP BY kind), o AS (SELECT kind, count(*) AS on_sheet FROM review GROUP BY kind) SELECT kind, found, coalesce(on_sheet, 0) AS on_sheet, round(coalesce(on_sheet, 0) / found::DOUBLE, 9) AS share FROM n LEFT JOIN o USING (kind)",
    "scores_sanity": f"WITH {SCORED}, m AS (SELECT clip_id, len(list_filter({lexed('reference')}, lambda t: list_contains({LEXICON}, t))) AS listed FROM clips) SELECT provider, count(*) AS clips, count_if(wer < 0 OR wer > 1) AS wer_outside, count_if(drug_mentions <> listed) AS other_mentions FROM scored JOIN m USING (clip_id) GROUP BY provider",
    "accuracy_without_collapsed": f"WITH {SCORED} SELECT provider, count_if(wer_spoken_punct_removed >= 0.8) AS collapsed, " + ", ".join(f"round(sum({ok}) / sum({n})::DOUBLE, 9) AS {name}_accuracy, round(sum({ok}) FILTER (WHERE wer_spoken_punct_removed < 0.8) / (sum({n}) FILTER (WHERE wer_spoken_punct_removed < 0.8))::DOUBLE, 9) AS {name}_accuracy_whole" for name, n, ok in (("drug", "drug_mentions", "drug_correct"), ("dose", "doses", "dose_correct + dose_unit_error"), ("negation", "negation_cues", "negation_preserved"))) + " FROM scored GROUP BY provider",
    "speaker_bootstrap": f"""WITH {SCORED}, s AS (SELECT provider, speaker_id, sum(drug_correct) AS c, sum(drug_mentions) AS n FROM scored JOIN (SELECT clip_id, speaker_id FROM clips) USING (clip_id) GROUP BY ALL
), u AS (SELECT *, ('0x' || substr(md5(concat_ws('|', speaker_id, round)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, (SELECT unnest(range(1, 201)) AS round)
), w AS (SELECT *, CASE {" ".join(f"WHEN u < {x!r}::DOUBLE THEN {k}" for k, x in enumerate(POISSON))} ELSE {len(POISSON)} END AS w FROM u
), r AS (SELECT provider, round, sum(w * c)::DOUBLE / sum(w * n)::DOUBLE AS share FROM w GROUP BY provider, round
), i AS (SELECT provider, quantile_cont(share, 0.025) AS low, quantile_cont(share, 0.975) AS high FROM r GROUP BY provider)
SELECT s.provider, count(*) AS speakers, round(sum(c)::DOUBLE / sum(n)::DOUBLE, 8) AS share, round(any_value(low), 8) AS low, round(any_value(high), 8) AS high FROM s JOIN i USING (provider) GROUP BY s.provider""",
    "case_scores": f"SELECT * FROM (VALUES {', '.join(_row((c.clip_id, *c.scores)) for c in cases.PAIRS)}) v(clip_id, {', '.join(SCORES)})",
    "case_findings": f"SELECT * FROM (VALUES {', '.join(_row((c.clip_id, k, *f)) for c in cases.PAIRS for k, f in enumerate(c.findings))}) v(clip_id, position, kind, expected, heard, ref_index)",
    "normalised_texts": f"SELECT * FROM (VALUES {', '.join(_row(t) for t in cases.TEXTS)}) v(raw, normalised)",
    "marked_texts": f"SELECT * FROM (VALUES {', '.join(_row((k, *m)) for k, m in enumerate(cases.MARKED))}) v(n, numbered, plain, ref_marked, hyp_marked, ref_excerpt, expected, heard_known)",
    "cache_round_trip": f"WITH {CACHE} SELECT clip_id::VARCHAR AS clip_id, provider, 'm' AS model, hypothesis AS text, latency_ms::DOUBLE AS latency_ms, audio_seconds, cost_usd FROM cache WHERE provider = 'p1'",
    "manifest_round_trip": f"WITH {MANIFEST} SELECT d.clip_id::VARCHAR AS clip_id, d.accent, d.tier, d.domain, d.duration, d.reference AS transcript, has_drug, drug_terms, has_dose, CASE WHEN has_dose THEN dose_strings END AS dose_strings, has_negation, has_entity, speaker_id::VARCHAR AS speaker_id FROM drawn d",
    "reported_payloads": f"WITH {CACHE} SELECT provider, clip_id, hypothesis AS text, CASE WHEN provider IN ('p0', 'p2', 'p4') THEN round(latency_ms) ELSE round(latency_ms + 0.4) END::DOUBLE AS latency_ms FROM cache",
    "wer_conversations": """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS r FROM conversations), p AS (SELECT a.conv_id, a.turn, a.r, b.r AS h FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(r) AS words, CASE WHEN len(r) > 0 THEN round(list_reduce(r, lambda a, x: list_reduce(list_transform(range(1, len(h) + 1), lambda j: least(a[j + 1] + 1, a[j] + (h[j] <> x)::BIGINT)), lambda n, v: list_append(n, least(v, n[len(n)] + 1)), [a[1] + 1]), range(0, len(h) + 1))[len(h) + 1] / len(r)::DOUBLE, 9) END AS wer FROM p""",
    "worst_failures": f"WITH {SCORED}, failed AS (SELECT *, {_BAND.format(0, 1, 2, 3)} AS band FROM scored WHERE {_FAILED}), dealt AS (SELECT *, row_number() OVER (PARTITION BY band, provider, tier ORDER BY wer DESC, clip_id) AS turn FROM failed) SELECT clip_id, provider, tier, band, turn, {_BAND.format(*(f'{chr(39)}{x}{chr(39)}' for x in ('DRUG-SUB candidate', 'DOSE-VAL candidate', 'NEG-FLIP candidate', 'high WER')))} AS auto_flag, round(wer, 9) AS wer FROM dealt ORDER BY band, turn, provider, tier, clip_id LIMIT 100",
    "accent_tiers": f"WITH {CLIPS_SQL} SELECT accent, tier FROM tiers WHERE tier IS NOT NULL",
    "stratified_draw": f"WITH {MANIFEST} SELECT clip_id, tier, accent, domain, has_entity FROM drawn",
    "sample_sheet": f"WITH {MANIFEST}, s AS (SELECT NULL AS tier, NULL AS domain, NULL AS accent, 'all' AS breakdown, count(*) AS clips, {_SHARES} FROM drawn UNION ALL SELECT tier, NULL, NULL, 'tier', count(*), {_SHARES} FROM drawn GROUP BY tier UNION ALL SELECT NULL, domain, NULL, 'domain', count(*), {_SHARES} FROM drawn GROUP BY domain UNION ALL SELECT tier, NULL, accent, 'accent', count(*), {_SHARES} FROM drawn GROUP BY tier, accent) SELECT tier, domain, accent, breakdown, clips, {_ROUNDED} FROM s",
    "quota_checks": f"""WITH {MANIFEST}, m AS (SELECT f.*, t.tier FROM full_manifest f JOIN tiers t USING (accent) WHERE t.tier IS NOT NULL), w AS (SELECT tier, clinical + general AS wanted FROM targets), c AS (SELECT tier, count(*) AS n, count(DISTINCT accent) AS accents, avg((domain = 'clinical')::INT) AS share FROM m GROUP BY tier), a AS (SELECT accent, count(*) AS n FROM m GROUP BY accent ORDER BY n DESC, accent DESC LIMIT 1)
SELECT rule, subject, round(found::DOUBLE, 9) AS found, wanted::DOUBLE AS wanted FROM (
  SELECT 'size' AS rule, CAST(NULL AS VARCHAR) AS subject, (SELECT count(*) FROM m)::DOUBLE AS found, (SELECT sum(wanted) FROM w)::DOUBLE AS wanted WHERE (SELECT count(*) FROM m) <> (SELECT sum(wanted) FROM w)
  UNION ALL SELECT 'tier count', w.tier, coalesce(n, 0), w.wanted FROM w LEFT JOIN c USING (tier) WHERE coalesce(n, 0) <> w.wanted
  UNION ALL SELECT 'accents in tier', tier, accents, 4 FROM c WHERE accents < 4
  UNION ALL SELECT 'clinical share', tier, share, 0.8 FROM c WHERE abs(share - 0.8) > 0.02
  UNION ALL SELECT 'accent cap', accent, n, 40 FROM a WHERE n > 40
  UNION ALL SELECT 'entity share', NULL, avg(has_entity::INT), 0.55 FROM m HAVING avg(has_entity::INT) < 0.55
  UNION ALL SELECT 'duration', NULL, count(*), 0 FROM m WHERE NOT duration BETWEEN 3 AND 30 HAVING count(*) > 0
  UNION ALL SELECT 'unique clip_id', NULL, count(*), 0 FROM (SELECT clip_id FROM m GROUP BY clip_id HAVING count(*) > 1) HAVING count(*) > 0)""",
    "duplicate_pairings": f"WITH {CLIPS_SQL}, g AS (SELECT reference AS subject, count(*) AS clips, count(DISTINCT speaker_id) AS speakers, array_to_string(list_slice(list_sort(list_distinct(list(clip_id))), 1, 100), ',') AS clip_ids FROM clips GROUP BY reference HAVING count(*) > 1) SELECT CASE WHEN speakers < clips THEN 'suspicious' ELSE 'expected' END AS verdict, CASE WHEN speakers < clips THEN 'one speaker, same transcript' ELSE 'same prompt, other speakers' END AS shape, subject, clips, clip_ids FROM g",
    "speech_rate_outliers": f"WITH {_RATE}",
    "repeated_line_items": "SELECT 'suspicious' AS verdict, concat_ws('/', l_orderkey, l_linenumber) AS subject, count(*) AS clips, array_to_string(list_slice(list_sort(list_distinct(list(l_partkey))), 1, 100), ',') AS clip_ids FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "lexicon_components": f"{_TERMS} {_COMPONENTS}",
    "lexicon_build": f"{_TERMS}, trusted AS ({_TRUSTED}), everything AS (SELECT term FROM trusted UNION SELECT term FROM brand WHERE term NOT IN ('steel', 'copper') OR term IN (SELECT term FROM trusted)) SELECT term FROM everything WHERE length(term) >= 4 AND regexp_matches(term, '[a-z]') AND term NOT IN {_BLOCKED}",
    "lexicon_round_trip": f"{_TERMS}, trusted AS ({_TRUSTED}), everything AS (SELECT term FROM trusted UNION SELECT term FROM brand WHERE term NOT IN ('steel', 'copper') OR term IN (SELECT term FROM trusted)) SELECT term FROM everything WHERE length(term) >= 4 AND regexp_matches(term, '[a-z]') AND term NOT IN {_BLOCKED}",
    "pending_clips": f"WITH {CACHE} SELECT clip_id, duration FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM cache WHERE provider = 'p2')",
    "spend_cap": f"""WITH {CACHE}, r AS (
  SELECT provider, clip_id, audio_seconds, coalesce(sum(CAST(cost_usd AS DECIMAL(28, 10))) OVER w, 0)::DOUBLE AS spent, count(*) OVER w AS before FROM cache
  WINDOW w AS (PARTITION BY provider ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT provider, min(before) AS last, arg_min(spent, before) AS stopped FROM r WHERE spent + CASE WHEN before > 0 THEN spent / before ELSE audio_seconds / 60 * 0.0077::DOUBLE END > 1.0 GROUP BY provider
)
SELECT provider, clip_id, round(CASE WHEN before >= last THEN stopped ELSE spent END, 6) AS spent, before < coalesce(last, before + 1) AS allowed FROM r LEFT JOIN e USING (provider)""",
    "run_summary": f"WITH {CACHE} SELECT provider, 'm' AS model, count(DISTINCT clip_id) AS clips_ok, round(sum(cost_usd), 4) AS cost_usd, round(median(latency_ms)) AS median_latency_ms, round(sum(audio_seconds) / 3600, 6) AS audio_hours FROM cache GROUP BY provider",
    "projected_cost": f"WITH {CLIPS_SQL}, m AS (SELECT sum(duration) / 60 AS minutes FROM clips) SELECT provider, round(minutes * price, 6) AS usd FROM m, (VALUES ('whisper', 0.0::DOUBLE), ('dg-general', 0.0077), ('dg-medical', 0.0077), ('aai', 0.0035), ('gemini', 0.0)) p(provider, price)",
    "cache_gates": f"WITH {CACHE} SELECT provider, count(*) AS answers, 1::BIGINT AS models, count_if(strlen(hypothesis) <> length(hypothesis)) AS non_ascii, count(*) >= (SELECT count(*) FROM clips) * 0.9875 AS complete FROM cache GROUP BY provider",
    "clips_per_speaker": f"WITH {CLIPS_SQL} SELECT clips, count(*) AS speakers FROM (SELECT speaker_id, count(*) AS clips FROM clips GROUP BY speaker_id) GROUP BY clips",
    "member_key_join": "WITH k AS (SELECT page_id, CASE WHEN ends_with(ltrim(trim(url), '/'), '.wav') THEN ltrim(trim(url), '/') ELSE concat(ltrim(trim(url), '/'), '.wav') END AS u FROM pages), p AS (SELECT page_id, array_to_string(list_slice(string_split(u, '/'), -2, -1), '/') AS key FROM k) SELECT key, (count(*) * count(*))::BIGINT AS pairs, min(page_id) AS first_page FROM p GROUP BY key",
    "secret_scan": f"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{SECRET.replace(chr(39), chr(39) * 2)}')",
}
