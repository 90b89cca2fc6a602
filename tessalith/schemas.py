"""Schemas of all tables; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "b": T.BooleanType(), "i": T.IntegerType(), "l": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in text.split())])


MANIFEST = _fields("clip_id:s split:s accent:s tier:s domain:s duration:d transcript:s has_drug:b drug_terms:s has_dose:b dose_strings:s has_negation:b has_entity:b gender:s age_group:s country:s speaker_id:s path:s")
TRANSCRIPTS = _fields("audio_ids:s audio_paths:s user_ids:s transcript:s accent:s domain:s duration:d gender:s age_group:s country:s")
CACHE = _fields("clip_id:s provider:s model:s text:s latency_ms:d audio_seconds:d cost_usd:d")
SUMMARY = _fields("provider:s model:s clips_ok:l clips_failed:l cost_usd:d median_latency_ms:d stopped_on_cap:b")
PROVIDERS = _fields("provider:s vendor:s model:s env_key:s usd_per_min:d free_tier:b")
DRUG_RECORD = T.StructType([T.StructField("generic_name", T.StringType()), T.StructField("brand_name", T.StringType()), T.StructField("active_ingredients", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))])
