"""Mixing sources to target weights along a time-varying curriculum.

1. Each document's size is its number of words; sources are given weights.
2. Targets: every source gets its weight's share of all words, but never more
   than ``max_repeats`` times what it has; the excess is shared again by weight
   until no source is above its ceiling (a water level, solved in closed form
   over the sources sorted by ceiling over weight).
3. Inside a source documents stand in the order of a hash of id and text.  The
   source is read from the front, again and again, until its target is reached;
   at most one document of a source is cut, after a whole word.
4. A weight schedule says how the source's share moves between the start (0)
   and the end (1) of training; a weight without one has a level share.  Its
   integral is the source's cumulative demand for words; inverting it at the
   word with which a copy begins gives the copy's training position.
5. Copies are range-sorted by position; a copy's rank is its place in that order.

Texts are read once to count words.  Everything up to the ranks happens on rows
of a few numbers each; texts move only to be put in order (``curriculum``).
The running sums never put a source into one task: a source is split by the
leading digits of its hashes, buckets are summed first, and the order (so the
result) is the same for any number of digits.  Rows that agree in id, source
and text are counted, not sorted, so a hot one is a single entry.

Defined results.  Null text or no word: size 0, takes nothing, one copy where
the source is taken whole.  A null source is a source, last in order.  Repeated
rows count each; ``curriculum`` shows the other columns of one of them.  Empty
table: no rows.  Columns of the input may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessalith.llm.kernel import Text, frugal, slices, words
from tessalith.llm.storage import removed, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
Knots = tuple[tuple[float, float], ...]
#: For each weight the schedule's knots (time, height): heavy sources early, light ones late.
SCHEDULES: dict[int, Knots] = {
    5: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (0.5, 1.25), (1.0, 0.75)),
    1: ((0.0, 0.5), (1.0, 1.5)),
}
LEVEL: Knots = ((0.0, 1.0), (1.0, 1.0))
#: Documents of one source in one window group, about.
GROUP_ROWS = 20_000
#: Keys up to which a table of them is sent to all workers.
BROADCAST_ROWS = 100_000


def source_key(docs: DataFrame, source_col: str) -> Column:
    """The source as text that sorts by code point; null behind every name, because "n" > "a"."""
    return F.when(docs[source_col].isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), docs[source_col].cast("string")))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Where a document stands in its source: a hash of id and text."""
    text = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit("|"), text))


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, key, id, size, rows): each different document with its number of words and how often it is there, written."""
    own = docs.select(source_key(docs, source_col).alias("source"), row_key(docs, id_col, text_col).alias("key"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    kind = own.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(words(text).counts.astype(np.int64))], names=["source", "key", "id", "size"])

    rows = own.mapInArrow(frugal(counted), f"source string, key string, id {kind}, size long")
    return written(rows.groupBy("source", "key", "id", "size").agg(F.count("*").alias("rows")), "mix-sizes")


def plan_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size) the same with ``weight`` and ``target``.

    One row per source: this table is small, and its three windows run in one task.
    """
    by_name, by_level = Window.orderBy("source"), Window.orderBy("level", "source")
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ceiling = F.col("source_size") * F.lit(max_repeats)
    levels = sources.withColumn("weight", weight).withColumn("level", ceiling / F.col("weight"))
    before = F.coalesce(F.sum(ceiling).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    water = (F.sum("source_size").over(everything) - before) / left
    levels = levels.withColumn("water", water)
    level = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "source", "water"))).over(everything)["water"]
    target = F.least(ceiling.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).select("source", "source_size", "weight", "target")


def position_of(share: Column, knots: Knots) -> Column:
    """The time at which the share of a schedule's whole integral is reached: the inverse, piece by piece."""
    area, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((area, t0, w0, (w1 - w0) / (t1 - t0)))
        area += (t1 - t0) * (w0 + w1) / 2
    y, out = share * F.lit(area), None
    for begin, t0, w0, slope in pieces:
        rest = y - F.lit(begin)
        t = F.lit(t0) + F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2 / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))))
        out = t if out is None else F.when(y >= begin, t).otherwise(out)
    return out


def position(weights: tuple[int, ...], schedules: dict[int, Knots], copy: Column) -> Column:
    """The training position of the ``copy``-th copy (from 0) of a placed document."""
    whole = F.floor("target").cast("long")
    share = F.when(whole > 0, (copy * F.col("source_size") + F.col("before")) / whole).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for weight in dict.fromkeys(weights):
        out = F.when(F.col("weight") == weight, position_of(share, schedules.get(weight, LEVEL))).otherwise(out)
    return out


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, key, nth, id, size, source_size, weight, target, before, taken, copies) of every row of ``docs``.

    ``before`` is the number of words of the source ahead of the document in
    its order; ``taken`` words are taken in all, in ``copies`` copies; ``nth``
    tells rows of one key apart.
    """
    sizes = with_sizes(docs, id_col, text_col, source_col)

    def buckets(digits: int) -> DataFrame:
        own = sizes.groupBy("source", F.left("key", F.lit(digits)).alias("bucket")).agg(F.sum(F.col("size") * F.col("rows")).alias("bucket_size"), F.count("*").alias("documents"))
        return written(own, "mix-buckets")

    digits = 3
    sums = buckets(digits)
    most = sums.agg(F.max("documents")).first()[0] or 0
    if most > GROUP_ROWS:  # a larger table: the same order, in finer groups
        removed(docs.sparkSession, sums)
        digits += math.ceil(math.log(most / GROUP_ROWS, 16))
        sums = buckets(digits)
    targets = plan_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("offset")).join(targets, "source")
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("bucket", F.left("key", F.lit(digits))).join(offsets, ["source", "bucket"])
    rows = rows.withColumn("before", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0)))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    whole = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - passes * F.col("source_size") - F.col("before")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(rest, F.lit(0)))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(passes).cast("int")
    rows = rows.withColumn("taken", taken.cast("long")).withColumn("copies", copies)
    return rows.select("source", "key", "nth", "id", "size", "source_size", "weight", "target", "before", "taken", "copies")


def copies_of(rows: DataFrame, weights: tuple[int, ...], schedules: dict[int, Knots] | None) -> DataFrame:
    """A row for each copy of placed documents: (source, key, nth, copy, words, position)."""
    out = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    words_ = F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("copy")).cast("long")
    return out.select("source", "key", "nth", "copy", "size", words_.alias("words"), position(weights, schedules or SCHEDULES, F.col("copy")).alias("position"))


ORDER = ("position", "source", "key", "nth", "copy")


def ranked(copies: DataFrame) -> DataFrame:
    """The copies with ``rank`` (from 0) in training order: range-sorted, numbered inside each range behind the rows of the ranges before."""
    sorted_ = written(copies.repartitionByRange(*ORDER).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = sorted_.groupBy("range").agg(F.count("*").alias("n"))
    ahead = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*ORDER))
    return sorted_.withColumn("inside", inside).join(F.broadcast(ahead), "range").withColumn("rank", F.col("ahead") + F.col("inside") - 1).drop("range", "inside", "ahead")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: dict[int, Knots] | None = None) -> DataFrame:
    """What the curriculum takes of each row: id, size, source_size, target, taken, copies, first_position and first_rank (null where nothing is taken)."""
    rows = written(placed(docs, id_col, text_col, source_col, weights, max_repeats), "mix-placed")
    order = ranked(copies_of(rows, weights, schedules))
    by_row = order.groupBy("source", "key", "nth").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"), F.min("position").alias("first_position"), F.min("rank").alias("first_rank"))
    out = rows.drop("taken", "copies").join(by_row, ["source", "key", "nth"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", F.lit(0).cast("long")).alias("copies"), "first_position", "first_rank")


@F.pandas_udf(StringType())
def _first_words(text: pd.Series, count: pd.Series) -> pd.Series:
    def cut(t: str | None, n: int) -> str | None:
        if t is None:
            return None
        own = Text(pa.array([t]))
        return own.data[: words(own).ends[n - 1]].tobytes().decode() if n else ""

    return pd.Series([cut(t, n) for t, n in zip(text, count, strict=True)], dtype=object)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: dict[int, Knots] | None = None) -> DataFrame:
    """The training order: a row for each copy that the mix takes, range-sorted by position.

    The columns of ``docs`` come first, then __copy (from 0), __words and
    __position.  A cut copy holds its first ``__words`` words.
    """
    rows = written(placed(docs, id_col, text_col, source_col, weights, max_repeats), "mix-placed")
    copies = copies_of(rows, weights, schedules)
    # The documents under names of their own, whatever theirs are.
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, kind = f"c{docs.columns.index(text_col)}", docs.schema[text_col].dataType
    own = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], source_key(docs, source_col).alias("source"), row_key(docs, id_col, text_col).alias("key"))
    again = written(rows.filter("nth = 1").select("source", "key").distinct(), "mix-again")
    many = again.count()
    if many:  # of rows that agree in id, source and text one stands for all
        again = F.broadcast(again) if many <= BROADCAST_ROWS else again
        one = own.join(again, ["source", "key"], "left_semi").dropDuplicates(["source", "key"])
        own = own.join(again, ["source", "key"], "left_anti").unionByName(one)
    joined = own.join(copies, ["source", "key"])
    partial = F.col("words") < F.col("size")
    cut = _first_words(F.when(partial, F.col(text).cast("string")), F.col("words"))
    joined = joined.withColumn("cut", cut).withColumn(text, F.when(partial, F.col("cut").cast(kind)).otherwise(F.col(text)))
    made = [F.col("copy").alias("__copy"), F.col("words").alias("__words"), F.col("position").alias("__position")]
    return joined.orderBy(*ORDER).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], *made)
