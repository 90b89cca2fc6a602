"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessalith.llm import mixing

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _position(share: str, knots: tuple[tuple[float, float], ...]) -> str:
    area, cases = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope, begin = (w1 - w0) / (t1 - t0), area
        area += (t1 - t0) * (w0 + w1) / 2
        cases.append((begin, t0, w0, slope))
    y = f"({share} * {area!r}::DOUBLE)"
    out = ""
    for begin, t0, w0, slope in cases[::-1]:
        rest = f"({y} - {begin!r}::DOUBLE)"
        t = f"{t0!r}::DOUBLE + CASE WHEN {rest} <= 0 THEN 0 ELSE {rest} * 2 / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {rest} * {2 * slope!r}::DOUBLE, 0))) END"
        out += f" WHEN {y} >= {begin!r}::DOUBLE THEN {t}" if begin else f" ELSE {t}"
    return f"CASE{out} END" if " WHEN" in out[:6] else f"({out.removeprefix(' ELSE ')})"


_MIX = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS.format("text")}) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, 3 * source_size / weight::DOUBLE AS level FROM r
), w AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM l
), x AS (
  SELECT first(water ORDER BY level, source NULLS LAST) AS level FROM w WHERE water <= level
), t AS (
  SELECT source, source_size, weight, least(3.0::DOUBLE * source_size, x.level * weight) AS target FROM w, x
), p AS (
  SELECT d.*, row_number() OVER () AS n, t.source_size, t.weight, t.target, floor(t.target)::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM p
), z AS (
  SELECT *, (passes * size + least(size, greatest(whole - passes * source_size - before, 0)))::BIGINT AS taken FROM q
), c AS (
  SELECT *, unnest(range(0, CASE WHEN size > 0 THEN ceil(taken / size::DOUBLE)::BIGINT ELSE passes END)) AS c FROM z
), h AS (
  SELECT *, CASE WHEN whole > 0 THEN (c * source_size + before) / whole::DOUBLE ELSE 0 END AS share FROM c
), a AS (
  SELECT *, CASE weight {" ".join(f"WHEN {w} THEN {_position('share', k)}" for w, k in mixing.SCHEDULES.items())} END AS position FROM h
), o AS (
  SELECT n, position, row_number() OVER (ORDER BY position, source NULLS LAST, k, before, c) - 1 AS rank FROM a
), g AS (
  SELECT n, count(*) AS copies, min(position) AS first_position, min(rank) AS first_rank FROM o GROUP BY n
)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken, coalesce(copies, 0)::BIGINT AS copies, round(first_position, 6) AS first_position, first_rank FROM z LEFT JOIN g USING (n)
"""

_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), d AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), u AS (
  SELECT doc_id, unnest(s) AS g FROM d
), n AS (
  SELECT doc_id, len(s) AS n FROM d
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), r(v, m) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT l.y, r.m FROM r JOIN l ON l.x = r.v
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""

ORACLES: dict[str, str] = {
    "op1_set_join": _JOIN,
    "op5_mixing": _MIX,
}
