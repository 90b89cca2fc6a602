"""How much a table reads, and what ``tessalith.shared`` offers for tables in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.shared import new_path, removed, shared_dir, written

__all__ = ["input_bytes", "new_path", "partitions_for", "removed", "shared_dir", "written"]

#: Catalyst reports about 2^63 bytes for rows that come from memory or an RDD.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Size of what ``df`` scans, from the plan's statistics; where the plan has none, its strings are measured."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < UNKNOWN:
        return known
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.coalesce(F.sum(sum(strings, F.lit(16))), F.lit(0))).first()[0])


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each gets about ``bytes_each`` of the input, and the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // bytes_each))
