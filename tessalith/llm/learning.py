"""What the classifiers share: folds by crc32 of the id, bounded labelled samples, Adam."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int, out: int) -> Column:
    """True for the rows whose labels are never learnt from: crc32(id as text) mod ``folds`` is ``out``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == out


#: Hash places of rows: a row's place is the same on every run and partitioning.
PLACES = 1 << 30


def place(*columns: str) -> Column:
    """A number from 0 to 1 by a hash of the columns, from which bounded samples are drawn in order."""
    return F.pmod(F.xxhash64(*columns), F.lit(PLACES)) / F.lit(float(PLACES))


def share_for(wanted: int, rows: int) -> float:
    """The share of places that surely holds ``wanted`` of ``rows`` rows: the mean and eight deviations more."""
    return 1.0 if rows <= wanted else min(1.0, (wanted + 8 * wanted**0.5 + 64) / rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sizes: dict[int, int], folds: int = 3, out: int = 1) -> DataFrame:
    """(i, t, y, w) of at most ``sizes[y]`` labelled documents of each class outside the held-out fold, each standing for ``w`` of its class.

    Classes are cut at different shares, so the classes' true share is that of
    the weights; counting rows would make it a matter of the table's size.

    Documents are chosen by a hash of the id, so the choice is the same on every
    run.  Only labels in the share of places that holds enough are sorted, so
    what reaches one task does not grow with the table.  The chosen ids are
    bounded by ``sizes``; therefore they may be broadcast to the documents.  A
    label that is there twice counts once; of several texts under one id the
    smallest is learnt from, so there are never more rows than chosen ids.
    """
    labels = labels.select(labels[id_col].cast("long").alias("i"), labels[label_col].cast("int").alias("y")).filter(F.col("y").isin(list(sizes)) & ~fold(F.col("i"), folds, out)).distinct()
    counts = {r.y: r["count"] for r in labels.groupBy("y").count().collect()}  # a row for each class
    chosen = None
    for y, n in sizes.items():
        near = labels.filter((F.col("y") == y) & (place("i") < share_for(n, counts.get(y, 0))))
        part = near.orderBy(place("i"), "i").limit(n).withColumn("w", F.lit(max(1.0, counts.get(y, 0) / n)))
        chosen = part if chosen is None else chosen.unionByName(part)
    own = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))
    return own.join(F.broadcast(chosen), "i").groupBy("i", "y", "w").agg(F.min("t").alias("t")).select("i", "t", "y", "w")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


class Adam:
    """Kingma and Ba's optimiser over a list of arrays, which it changes in place."""

    def __init__(self, parameters: list[np.ndarray], rate: float = 1e-2):
        self.parameters, self.rate, self.t = parameters, rate, 0
        self.m = [np.zeros_like(p) for p in parameters]
        self.v = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def temperature(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The divisor of the logits with the least log loss on rows that the network did not learn from."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        return float(np.average(np.logaddexp(0, z) - labels * z, weights=weight))

    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
    return float(min(grid, key=loss))


