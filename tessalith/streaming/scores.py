"""Scores of transcripts as they arrive.

An extension: a batch run over the whole cache gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessalith.operators import scoring
from tessalith.schemas import CACHE


def stream_cache(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """New answers under ``root/<provider>/`` as they appear."""
    return spark.readStream.schema(CACHE).option("maxFilesPerTrigger", files_at_once).option("multiLine", True).json(f"{root}/[^_]*")


def score_stream(answers: DataFrame, manifest: DataFrame, lexicon: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Score each micro-batch against the (static) manifest and hand it to ``write``; every file is scored once."""

    def scored(batch: DataFrame, _: int) -> None:
        write(scoring.score_clips(scoring.merge(batch, manifest), lexicon))

    return answers.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
