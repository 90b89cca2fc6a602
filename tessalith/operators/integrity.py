"""Checks of a manifest against its audio and against itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessalith.functions.text import words
from tessalith.operators.scoring import draw_key

RATE_LOW, RATE_HIGH, USUAL_RATE = 0.25, 4.0, 1.67
DURATION_LOW, DURATION_HIGH, SILENCE = 0.5, 1.5, 0.001
SPOT_CHECKS, MOST_FLAGGED = 20, 2


def speech_rate_bounds(manifest: DataFrame) -> DataFrame:
    """One row (low, high): a quarter and four times the median rate in words a second; the usual rate if there is none."""
    rate = F.try_divide(F.size(words(F.coalesce("transcript", F.lit("")))), F.col("duration"))
    median = F.median(rate)
    centre = F.when(median > 0, median).otherwise(F.lit(USUAL_RATE))
    return manifest.agg((centre * RATE_LOW).alias("low"), (centre * RATE_HIGH).alias("high"))


def speech_rate_reason(transcript: Column, seconds: Column, low: Column, high: Column) -> Column:
    """Why the transcript does not fit the duration; null if it does."""
    n = F.size(words(F.coalesce(transcript, F.lit(""))))
    rate = F.try_divide(n.cast("double"), seconds)
    text = F.format_string("%.2f words per second (%d words in %.1fs), outside %.2f to %.2f", F.bround(rate, 2), n, F.bround(seconds, 1), F.bround(low, 2), F.bround(high, 2))  # halves to even, as elsewhere
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, F.lit("zero duration, cannot compute a speech rate")).when(~rate.between(low, high), text)


def duration_reason(actual: Column, expected: Column) -> Column:
    """Why the audio's length does not fit; a null length is a missing file."""
    text = F.format_string("duration %.1fs against an expected %.1fs, outside %.1fx to %.1fx", actual, expected, F.lit(DURATION_LOW), F.lit(DURATION_HIGH))
    return F.when(actual.isNull(), F.lit("missing audio file")).when(~actual.between(expected * DURATION_LOW, expected * DURATION_HIGH), text)


def silence_reason(rms: Column) -> Column:
    return F.when(rms.isNull(), F.lit("missing audio file")).when(rms < SILENCE, F.format_string("silent: RMS %.6f below %s", rms, F.lit(str(SILENCE))))


def spot_check_sample(manifest: DataFrame, n: int = SPOT_CHECKS) -> DataFrame:
    """``n`` clips by a fixed shuffle."""
    return manifest.orderBy(draw_key("clip_id"), "clip_id").limit(n)


def spot_check(manifest: DataFrame, audio: DataFrame, n: int | None = SPOT_CHECKS) -> DataFrame:
    """(clip_id, reasons) of the checked clips with something wrong; ``audio`` has clip_id, seconds, rms, error. All clips for ``n`` None."""
    bounds = speech_rate_bounds(manifest)
    chosen = (manifest if n is None else spot_check_sample(manifest, n)).join(audio, "clip_id", "left").crossJoin(F.broadcast(bounds))  # one row
    unreadable = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable audio: "), F.col("error")))
    reasons = F.array_distinct(F.array_compact(F.array(F.coalesce(unreadable, duration_reason(F.col("seconds"), F.col("duration"))), F.when(unreadable.isNull(), silence_reason(F.col("rms"))), speech_rate_reason(F.col("transcript"), F.col("duration"), F.col("low"), F.col("high")))))
    return chosen.select("clip_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def duplicate_pairings(manifest: DataFrame) -> DataFrame:
    """(verdict, shape, subject, clips, clip_ids) of transcripts and paths that stand in several rows.

    A prompt read by as many speakers as rows is ``expected``; a speaker with
    one transcript twice, or rows that share a path, are ``suspicious``.
    ``clip_ids`` lists a group's smallest ids up to ``LISTED``; ``clips`` counts all.
    """
    def listed(rows: DataFrame, subject: str) -> DataFrame:
        """(subject, clips, ids): all rows are counted, the smallest ids collected: a group of any size sends ``LISTED`` of each part of it."""
        ids = rows.select(subject, "clip_id").distinct().withColumn("part", F.pmod(F.xxhash64("clip_id"), F.lit(PARTS)))
        few = ids.withColumn("n", F.row_number().over(Window.partitionBy(subject, "part").orderBy("clip_id"))).filter(F.col("n") <= LISTED)
        return few.groupBy(subject).agg(F.slice(F.array_sort(F.collect_set("clip_id")), 1, LISTED).alias("clip_ids"))

    rows = manifest.select("clip_id", F.trim("transcript").alias("subject"), "speaker_id", F.trim("path").alias("path"))
    texts = rows.groupBy("subject", "speaker_id").agg(F.count("*").alias("n")).groupBy("subject").agg(F.sum("n").alias("clips"), F.count("*").alias("speakers")).filter("clips > 1")
    texts = texts.join(listed(rows.join(texts.select("subject"), "subject", "left_semi"), "subject"), "subject")
    verdict = F.when(F.col("speakers") < F.col("clips"), "suspicious").otherwise("expected")
    shape = F.when(F.col("speakers") < F.col("clips"), "one speaker, same transcript").otherwise("same prompt, other speakers")
    paths = rows.groupBy("path").agg(F.count("*").alias("clips")).filter("clips > 1")
    paths = paths.join(listed(rows.join(paths.select("path"), "path", "left_semi"), "path"), "path").withColumnRenamed("path", "subject")
    return texts.select(verdict.alias("verdict"), shape.alias("shape"), "subject", "clips", "clip_ids").unionByName(paths.select(F.lit("suspicious").alias("verdict"), F.lit("rows share audio").alias("shape"), "subject", "clips", "clip_ids"))


LISTED, PARTS = 100, 64


def should_halt(flagged: int, suspicious: int) -> bool:
    return flagged > MOST_FLAGGED or suspicious > 0


def outcome(manifest: DataFrame, audio: DataFrame) -> dict:
    """What a run decides on: checked and flagged clips (with reasons), pairings by verdict, and whether to halt."""
    findings = [(r.clip_id, list(r.reasons)) for r in spot_check(manifest, audio).collect()]  # SPOT_CHECKS rows at most
    verdicts = {r.verdict: r["count"] for r in duplicate_pairings(manifest).groupBy("verdict").count().collect()}
    suspicious = verdicts.get("suspicious", 0)
    return {"checked": min(SPOT_CHECKS, manifest.count()), "flagged": len(findings), "findings": sorted(findings), "suspicious": suspicious, "expected": verdicts.get("expected", 0), "halt": should_halt(len(findings), suspicious)}
