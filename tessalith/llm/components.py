"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.llm.storage import removed, written

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for every vertex of the edges (a, b) the smallest vertex that it reaches.

    Each round gives every label the smallest label next to it, halves the
    resulting paths a few times, and drops edges whose ends have met; a path of
    n labels is at most n / 2^JUMPS long after a round.  Labels and edges live
    in tables of the shared folder; nothing is collected.
    """
    spark = edges.sparkSession
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = written(left.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v")), "labels")
    while not left.isEmpty():
        near = left.select(F.col("b").alias("r"), F.col("a").alias("m")).unionByName(left.select(F.col("a").alias("r"), F.col("a").alias("m")))
        step = written(near.groupBy("r").agg(F.min("m").alias("m")), "steps")
        for _ in range(JUMPS):
            far = step.select(F.col("r").alias("m"), F.col("m").alias("n"))
            old, step = step, written(step.join(far, "m", "left").select("r", F.coalesce("n", "m").alias("m")), "steps")
            removed(spark, old)
        moved = step.select(F.col("r").alias("c"), "m")
        old, labels = labels, written(labels.join(moved, "c", "left").select("v", F.coalesce("m", "c").alias("c")), "labels")
        removed(spark, old)
        at = left.join(step.select(F.col("r").alias("a"), F.col("m").alias("x")), "a").join(step.select(F.col("r").alias("b"), F.col("m").alias("y")), "b")
        old, left = left, written(at.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
        removed(spark, old, step)
    removed(spark, left)
    return labels
