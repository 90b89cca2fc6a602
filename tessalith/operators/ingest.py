"""Filling the transcript cache: pending clips, retries, a spend cap, and summaries from the cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessalith.schemas import CACHE, PROVIDERS
from tessalith.shared import written

# Configurations and list prices.
CATALOGUE = (
    ("whisper", "groq", "whisper-large-v3", "GROQ_API_KEY", 0.0, True),
    ("dg-general", "deepgram", "nova-3", "DEEPGRAM_API_KEY", 0.0077, True),
    ("dg-medical", "deepgram", "nova-3-medical", "DEEPGRAM_API_KEY", 0.0077, True),
    ("aai", "assemblyai", "universal-3-5-pro", "ASSEMBLYAI_API_KEY", 0.0035, True),
    ("gemini", "google", "gemini-3.5-flash-lite", "GOOGLE_API_KEY", 0.0, True),
)
# Where each vendor's answer has the text.
TEXT_PATHS = {"groq": "$.text", "deepgram": "$.results.channels[0].alternatives[0].transcript", "assemblyai": "$.text", "google": "$.candidates[0].content.parts[0].text"}
SPEND_CAP = 20.0
TRIES = 5


class Permanent(Exception):
    """The provider refuses this clip."""


class Transient(Exception):
    """Rate limit, server or network trouble: worth another try."""


def classify(status: int, body: str = "") -> None:
    """Raise what an HTTP status means: 429 and 5xx may be tried again, other failures not."""
    if status == 429 or status >= 500:
        raise Transient(f"HTTP {status}")
    if not 200 <= status < 300:
        raise Permanent(f"HTTP {status}: {body[:200]}")


def with_backoff(call: Callable[[], dict], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """The result of ``call``; after a transient failure 2, 4, 8 ... seconds later; None after a permanent one or the last try."""
    for attempt in range(tries):
        try:
            return call()
        except Permanent:
            return None
        except (Transient, OSError):
            if attempt < tries - 1:
                sleep(2**attempt)
    return None


def providers(spark) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), PROVIDERS)


def list_cost(seconds: Column, usd_per_minute: Column) -> Column:
    return seconds / 60 * usd_per_minute


def reported_number(payload: Column, path: str) -> Column:
    """A positive number from a JSON answer; null if it is missing or unusable."""
    value = F.get_json_object(payload, path).try_cast("double")
    return F.when(value > 0, value)


def reported_text(payload: Column, vendor: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, path in TEXT_PATHS.items():
        out = F.when(vendor == name, F.get_json_object(payload, path)).otherwise(out)
    return out


def latency_ms(payload: Column, path: str, wall_clock: Column) -> Column:
    """The vendor's own figure in whole milliseconds where it gives a usable one, else what the clock said."""
    return F.coalesce(F.round(reported_number(payload, path)), F.round(wall_clock)).cast("double")


def projected_cost(manifest: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(provider, usd): list price times minutes; one manifest total against the few providers."""
    minutes = manifest.agg((F.sum("duration") / 60).alias("minutes")).first()[0] or 0.0
    return catalogue.select("provider", (F.lit(float(minutes)) * F.col("usd_per_min")).alias("usd"))


def pending(manifest: DataFrame, cache: DataFrame, provider: str, audio: DataFrame | None = None) -> DataFrame:
    """Clips that the provider has no answer for yet, and only those with audio where ``audio`` (clip_id) is given."""
    left = manifest.join(cache.filter(F.col("provider") == provider).select("clip_id"), "clip_id", "left_anti")
    return left if audio is None else left.join(audio.select("clip_id").distinct(), "clip_id", "left_semi")


def within_cap(calls: DataFrame, cap: float = SPEND_CAP, order: str = "clip_id", by: str = "provider") -> DataFrame:
    """Calls in order with ``spent`` before each and whether the cap still ``allowed`` it.

    A call is allowed if what is spent and the estimate for it stay within the
    cap; the estimate is the mean cost so far, or the list price for the first.
    The first call that is not allowed ends its provider's run: no later one is
    allowed, and none of them counts as spent.  The order is that of the column,
    of any type, then of the cost.  The running sum goes by ranges of the order
    that are summed first, so one provider's calls are never in one task;
    amounts are exact decimals, so the order of addition does not matter.
    """
    money, zero = F.col("cost_usd").cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)")
    rows = written(calls.repartitionByRange(by, order, "cost_usd").withColumn("__part", F.spark_partition_id()), "calls")
    sums = rows.groupBy(by, "__part").agg(F.sum(money).alias("s"), F.count("*").alias("c"))
    ahead = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "__part", F.coalesce(F.sum("s").over(ahead), zero).alias("__s"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("__c"))
    own = Window.partitionBy(by, "__part").orderBy(order, "cost_usd").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(sums), [by, "__part"])  # a row for each range and provider
    out = out.withColumns({"__spent": (F.col("__s") + F.coalesce(F.sum(money).over(own), zero)).cast("double"), "__before": F.col("__c") + F.count("*").over(own)})
    estimate = F.when(F.col("__before") > 0, F.col("__spent") / F.col("__before")).otherwise(F.col("list_cost"))
    ends = out.filter(F.col("__spent") + estimate > cap).groupBy(by).agg(F.min(F.struct("__before", "__spent")).alias("__end"))
    out = out.join(F.broadcast(ends), by, "left")  # a row for each provider
    done = F.col("__before") >= F.col("__end.__before")
    return out.select(*calls.columns, F.when(done, F.col("__end.__spent")).otherwise(F.col("__spent")).alias("spent"), (~F.coalesce(done, F.lit(False))).alias("allowed"))


#: Share of the clips that a provider must have answered: 395 of 400.
COMPLETE = 0.9875


def cache_gates(cache: DataFrame, clips: DataFrame, share: float = COMPLETE) -> DataFrame:
    """By provider: answers, models, answers in other than ASCII, and whether at least ``share`` of the clips are answered."""
    odd = F.col("text").rlike(r"[^\x00-\x7F]").cast("int")
    counts = cache.groupBy("provider").agg(F.count("*").alias("answers"), F.countDistinct("model").alias("models"), F.sum(odd).alias("non_ascii"))
    wanted = clips.agg((F.count("*") * F.lit(share)).alias("__wanted"))  # one row
    return counts.crossJoin(F.broadcast(wanted)).withColumn("complete", F.col("answers") >= F.col("__wanted")).drop("__wanted")


def run_summary(cache: DataFrame) -> DataFrame:
    """(provider, model, clips_ok, cost_usd, median_latency_ms, audio_hours), always from the cache, so a resumed run counts right."""
    return cache.groupBy("provider", "model").agg(F.countDistinct("clip_id").alias("clips_ok"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.median("latency_ms")).alias("median_latency_ms"), (F.sum("audio_seconds") / 3600).alias("audio_hours"))


@dataclass
class Outcome:
    """What a provider's run did; costs and counts for the whole cache come from ``run_summary``."""

    provider: str
    clips_ok: int = 0
    clips_failed: int = 0
    cost_usd: float = 0.0
    stopped_on_cap: bool = False


def run_provider(provider: str, model: str, usd_per_minute: float, clips: Iterable[dict], transcribe: Callable[[dict], dict], store: Callable[[dict], None], cap: float = SPEND_CAP, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Call ``transcribe`` for each pending clip and ``store`` each answer; stop before the call that would pass the cap.

    An answer is stored as soon as it is there and failures never are, so a
    run that breaks off resumes where it stopped.  Spending is sequential by
    nature, so this loop is on the driver; without a cap ``transcribe_all``
    spreads the calls.
    """
    out = Outcome(provider)
    paid = 0
    for clip in clips:
        estimate = out.cost_usd / paid if paid else clip["duration"] / 60 * usd_per_minute
        if out.cost_usd + estimate > cap:
            out.stopped_on_cap = True
            break
        answer = with_backoff(lambda clip=clip: transcribe(clip), sleep=sleep)
        if answer is None:
            out.clips_failed += 1
            continue
        cost = float(answer.get("cost_usd") or 0.0)
        latency = answer.get("latency_ms")
        store({"clip_id": clip["clip_id"], "provider": provider, "model": model, "text": answer["text"], "latency_ms": None if latency is None else float(latency), "audio_seconds": float(clip["duration"]), "cost_usd": cost})
        out.cost_usd, paid, out.clips_ok = out.cost_usd + cost, paid + 1, out.clips_ok + 1
    return out


def run_all(manifest: DataFrame, cache_of: Callable[[], DataFrame], store: Callable[[dict], None], transcribe: Callable[[str], Callable[[dict], dict]], catalogue=CATALOGUE, cap: float = SPEND_CAP, sleep: Callable[[float], None] = time.sleep) -> list[Outcome]:
    """Every provider in turn under one cap, each with one more pass over what failed; what is spent in both passes counts."""
    spent, outcomes = 0.0, []
    minutes = (manifest.agg(F.sum("duration")).first()[0] or 0.0) / 60
    for provider, _, model, _, price, _ in catalogue:
        if minutes * price > cap or spent >= cap:
            continue
        total = Outcome(provider)
        for _ in range(2):
            clips = (r.asDict() for r in pending(manifest, cache_of(), provider).select("clip_id", "duration").orderBy("clip_id").toLocalIterator())
            done = run_provider(provider, model, price, clips, transcribe(provider), store, cap - spent, sleep)
            spent += done.cost_usd
            total = Outcome(provider, total.clips_ok + done.clips_ok, done.clips_failed, total.cost_usd + done.cost_usd, done.stopped_on_cap)
            if not done.clips_failed or done.stopped_on_cap:
                break
        outcomes.append(total)
    return outcomes


def transcribe_all(clips: DataFrame, provider: str, model: str, transcribe: Callable[[dict], dict]) -> DataFrame:
    """Answers for all clips, called from the executors (no cap); clips without an answer give no row."""
    columns = CACHE.fieldNames()

    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for clip in batch.to_dict("records"):
                answer = with_backoff(lambda clip=clip: transcribe(clip))
                if answer is not None:
                    rows.append((clip["clip_id"], provider, model, answer["text"], answer.get("latency_ms"), clip["duration"], float(answer.get("cost_usd") or 0.0)))
            yield pd.DataFrame(rows, columns=columns)

    return clips.select("clip_id", "duration").mapInPandas(called, CACHE)
