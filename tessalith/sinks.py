"""Outputs: CSV, text and JSON tables by Spark, and small pages and reports put together on the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith.operators.integrity import MOST_FLAGGED
from tessalith.schemas import MANIFEST
from tessalith.shared import put
from tessalith.sources import tables

#: A page is put together on the driver, so it shows so many rows at most; a larger table is an error and belongs into a CSV or Parquet.
PAGE_ROWS = 10_000

# The codes; what they mean, in words of our own.
CODES = {
    "DRUG-SUB": "another drug of the lexicon stands where this one was said",
    "DRUG-DEL": "the drug's name is missing, or what stands there is no drug",
    "DOSE-VAL": "the unit is right and the number is not",
    "DOSE-UNIT": "the number is right and the unit is not",
    "DOSE-MISS": "neither number nor unit of the dose came through",
    "NEG-FLIP": "a negation is gone, so the statement turns round",
    "TERM-CORRUPT": "a clinical term became another one that reads well",
    "PHON-ACCENT": "the sound of the accent explains the error (listen first)",
    "ASR-COLLAPSE": "nothing of the recording came through, not just an entity",
    "BENIGN": "an error that changes no clinical meaning",
    "NO-ERROR": "a false alarm: the transcript is right",
}
SEVERITIES = {
    "S1": "unnoticed, it could change what is done for the patient",
    "S2": "it misleads, but a reader would probably notice",
    "S3": "it only looks wrong",
}


def page_rows(rows: DataFrame) -> list:
    """The rows of a page, in their order; too many for a page are an error, never cut."""
    found = rows.limit(PAGE_ROWS + 1).collect()
    if len(found) > PAGE_ROWS:
        raise ValueError(f"more than {PAGE_ROWS} rows for a page: write the table as CSV or Parquet")
    return found


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; one file for summaries and sheets, several for tables that grow."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as CSV with its fixed columns in order; a column that the manifest lacks is empty."""
    columns = [F.col(f.name).cast(f.dataType) if f.name in manifest.columns else F.lit(None).cast(f.dataType) for f in MANIFEST.fields]
    write_csv(manifest.select(*[c.alias(f.name) for c, f in zip(columns, MANIFEST.fields, strict=True)]), path)


def write_lexicon(terms: DataFrame, path: str) -> None:
    """Sorted unique terms, one a line."""
    terms.select(F.col(terms.columns[0]).alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def built_lexicon(spark: SparkSession, path: str, make: Callable[[], DataFrame], fallback: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The lexicon under ``path``: read where it is there (unless ``force``), else made and written.

    ``make`` asks a service for records; where that fails on the line, the terms of
    ``fallback`` are taken, and without one it is an error.
    """
    if force or not tables.exists(spark, path):
        try:
            write_lexicon(make(), path)
        except OSError:
            if fallback is None:
                raise
            write_lexicon(fallback, path)
    return tables.read_lexicon(spark, path)


def append_cache(answers: DataFrame, path: str) -> None:
    """Answers as Parquet by provider: a rerun appends what was pending, and a reader prunes by provider."""
    answers.write.mode("append").partitionBy("provider").parquet(path)


def store_json(root: str):
    """A function that stores one answer as root/provider/clip.json, whole or not at all, in whatever store ``root`` names."""

    def store(record: dict) -> None:
        put(f"{root}/{record['provider']}/{record['clip_id']}.json", json.dumps(record, indent=2).encode())

    return store


def write_wavs(clips: DataFrame, folder: str) -> None:
    """WAV files (clip_id, content) into a folder of the store that its URI names, from the executors; a task that runs twice writes the same files."""

    def write(rows) -> None:
        for r in rows:
            if r.content is not None:
                put(f"{folder}/{r.clip_id}.wav", bytes(r.content))

    clips.select("clip_id", "content").foreachPartition(write)


def _page(title: str, body: str) -> str:
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body>\n<h1>{html.escape(title)}</h1>\n{body}\n</body></html>\n'


def review_page(cards: DataFrame, audio: str = "audio") -> str:
    """Cards with player, texts and findings, each with empty choices of code and severity."""
    choices = lambda names: "".join(f"<option>{html.escape(n)}</option>" for n in ("", *names))
    out = [f"<p>{html.escape('; '.join(f'{k}: {v}' for k, v in (CODES | SEVERITIES).items()))}</p>"]
    for card in page_rows(cards.orderBy("first")):
        rows = "".join(
            f'<li data-finding="{f.finding_id}">{f.position}. {html.escape(f.kind)}: {html.escape(f.expected)} &rarr; {html.escape(f.heard)}'
            f"<p>{html.escape(f.ref_excerpt)}</p><p>{html.escape(f.hyp_excerpt)}</p><select>{choices(CODES)}</select><select>{choices(SEVERITIES)}</select></li>"
            for f in card.findings
        )
        out.append(f'<section><h2>{html.escape(str(card.clip_id))} {html.escape(card.provider)}</h2><audio controls src="{html.escape(audio)}/{html.escape(str(card.clip_id))}.wav"></audio><ol>{rows}</ol></section>')
    return _page("Review", "\n".join(out))


def listen_page(chosen: DataFrame, findings: list[tuple[str, list[str]]], audio: str = "audio") -> str:
    """The spot-checked clips with player and transcript, and what the checks found."""
    flagged = dict(findings)
    out = []
    for r in page_rows(chosen):
        note = f"<strong>{html.escape('; '.join(flagged[r.clip_id]))}</strong>" if r.clip_id in flagged else ""
        out.append(f'<section><h2>{html.escape(str(r.clip_id))}</h2>{note}<audio controls src="{html.escape(audio)}/{html.escape(str(r.clip_id))}.wav"></audio><p>{html.escape(r.transcript or "")}</p></section>')
    return _page(f"Spot listen: {len(out)} clips", "\n".join(out))


def integrity_report(outcome: dict, pairings: DataFrame) -> str:
    """The outcome of the checks as Markdown."""
    lines = ["# Integrity check", "", f"**Outcome: {'HALT' if outcome['halt'] else 'PASS'}**", "", f"- Clips checked: {outcome['checked']}", f"- Flagged: {outcome['flagged']} (halt above {MOST_FLAGGED})", f"- Suspicious pairings: {outcome['suspicious']}", f"- Expected repeated prompts: {outcome['expected']}", "", "## Flagged clips", ""]
    lines += [f"- `{clip}`: {'; '.join(reasons)}" for clip, reasons in outcome["findings"]] or ["None."]
    for verdict in ("suspicious", "expected"):
        rows = page_rows(pairings.filter(F.col("verdict") == verdict).orderBy("shape", "subject"))
        lines += ["", f"## {verdict.capitalize()} pairings", "", *([f"- {r['shape']} ({r['clips']}): {', '.join(map(str, r['clip_ids']))}" for r in rows] or ["None."])]
    return "\n".join(lines) + "\n"


def instructions() -> str:
    return "\n".join(["Open the review page: one card per recording; play it, read it, judge each finding.", "One code and one severity per finding; add errors that have no finding.", "Codes: " + "; ".join(f"{k} {v}" for k, v in CODES.items()), "Severity: " + "; ".join(f"{k} {v}" for k, v in SEVERITIES.items()), "Ask of each: would this change what a clinician does, if nobody caught it?"])
