"""Toxicity: logistic regression that is taught to ignore which group a sentence names.

Features are the distinct lower-cased words of a document and their stems
(first ``STEMS`` bytes), hashed into a fixed number of weights.  In training every
labelled sentence that names a group is copied with the name swapped for each
other name of its list, and the loss gets ``PENALTY`` times the squared change
of the logit: weight on a group's name, which raises neutral mentions, costs
more than it explains.

It learns from at most ``sum(SAMPLE)`` labelled documents.  Features are counted
and chosen in the executors; of each labelled document only the chosen ones reach
the driver.  Every document is scored whole.

Defined results.  Null and empty texts have no feature and get the score of
the bias.  Without labels of both classes every score is the share of label 1
(0 without any).  Repeated rows count each; empty table: no rows; columns
besides id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.llm.kernel import U64, Text, frugal, give_back, mixed, slices, word_and_symbol_runs
from tessalith.llm.learning import Adam, fold, labelled_sample, sigmoid
from tessalith.llm.storage import removed, written

#: Weights, bytes of stems, documents of the positive class that must have a feature.
DIMENSIONS, STEMS, LEAST_POSITIVE = 1 << 20, (5, 7, 9), 2
PENALTY, L2, STEPS, LEAST_ASSOCIATION = 1.0, 1e-3, 400, 12.0
#: Labelled documents of each class that are learnt from at most.
SAMPLE = {0: 16_000, 1: 8_000}
THRESHOLD = 0.7

# Names of groups that can stand for each other in a sentence.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indian"),
    ("blacks", "whites", "asians", "latinos", "hispanics", "africans", "europeans", "arabs", "indians"),
    ("american", "mexican", "chinese", "russian", "german", "french", "british", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("muslimisch", "christlich", "jüdisch", "katholisch", "evangelisch"),
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "ausländer", "flüchtlinge"),
    ("musulmán", "cristiano", "judío", "católico", "ateo"),
    ("mujer", "hombre", "chica", "chico"),
    ("mujeres", "hombres", "inmigrantes", "refugiados"),
)
_GROUP_OF = {name: g for g in GROUPS for name in g}
_NAMES = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _GROUP_OF), key=len, reverse=True)) + r")\b", re.IGNORECASE)


_LONGEST = max(map(len, GROUPS))


def swapped(text: str) -> list[str]:
    """Copies of ``text``, each with all its group names moved on by the same number of places in their lists, until every other name was there."""
    if not _NAMES.search(text):
        return []

    def moved(by: int) -> str:
        def other(m: re.Match) -> str:
            group = _GROUP_OF[m[0].lower()]
            return group[(group.index(m[0].lower()) + by) % len(group)]

        return _NAMES.sub(other, text)

    return [x for x in dict.fromkeys(moved(by) for by in range(1, _LONGEST)) if x.lower() != text.lower()]


def features(text: Text) -> list[np.ndarray]:
    """Sorted distinct features of each row."""
    runs = word_and_symbol_runs(text)
    word = runs.kind == 1
    starts, ends, row = runs.starts[word], runs.ends[word], runs.row[word]
    values, rows = [text.span_hashes(starts, ends, lower=True)], [row]
    for size in STEMS:
        long = ends - starts > size
        values.append(mixed(text.span_hashes(starts[long], starts[long] + size, lower=True) ^ U64(0x452821E638D01377)))
        rows.append(row[long])
    both = np.unique(np.concatenate(rows) * DIMENSIONS + (np.concatenate(values) % U64(DIMENSIONS)).astype(np.int64))
    at = np.searchsorted(both, np.arange(len(text) + 1) * DIMENSIONS)
    return [(both[a:b] % DIMENSIONS).astype(np.int32) for a, b in zip(at, at[1:], strict=False)]


class Rows:
    """Sparse binary rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n)

    def transposed(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, r[self.row], size)


def association(positive: np.ndarray, total: np.ndarray, all_positive: int, n: int) -> np.ndarray:
    """Pearson's chi-square of having a feature and having label 1, where the feature raises the label's share; else 0."""
    a, b = positive.astype(float), (total - positive).astype(float)
    c, d = all_positive - a, n - all_positive - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    return np.where((a * d > b * c) & np.isfinite(chi), chi, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], penalty: float = PENALTY, stands_for: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias from feature rows, labels, (row, features of its swapped copy), and how many labelled rows each row stands for (one by default)."""
    share = float(np.average(labels, weights=stands_for)) if len(labels) else 0.0
    part = np.full(len(labels), 1 / max(1, len(labels))) if stands_for is None else stands_for / stands_for.sum()
    if share in (0.0, 1.0):
        return np.zeros(DIMENSIONS, np.float32), math.inf if share else -math.inf
    positive = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, y in zip(rows, labels, strict=True) if y)]), minlength=DIMENSIONS)
    total = np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=DIMENSIONS)
    names = np.zeros(DIMENSIONS, bool)
    names[np.concatenate([np.zeros(0, np.int32), *features(Text(pa.array(sorted(_GROUP_OF))))])] = True
    kept = np.flatnonzero((positive >= LEAST_POSITIVE) & ((association(positive, total, int(labels.sum()), len(labels)) >= LEAST_ASSOCIATION) | names))
    small = np.full(DIMENSIONS, -1, np.int64)
    small[kept] = np.arange(len(kept))
    own = lambda r: (x := small[r])[x >= 0]
    x = Rows([own(r) for r in rows])
    first, second = Rows([own(rows[k]) for k, _ in pairs]), Rows([own(r) for _, r in pairs])
    w, b, y = np.zeros(len(kept)), np.array([math.log(share / (1 - share))]), labels.astype(float)
    adam = Adam([w, b], 0.05)
    for _ in range(STEPS):
        error = (sigmoid(x.times(w) + b[0]) - y) * part
        gradient = x.transposed(error, len(w)) + L2 * w / math.sqrt(len(y))
        if pairs:
            change = 2 * penalty * (first.times(w) - second.times(w)) / len(pairs)
            gradient += first.transposed(change, len(w)) - second.transposed(change, len(w))
        adam.step([gradient, np.array([error.sum()])])
    out = np.zeros(DIMENSIONS, np.float32)
    out[kept] = w
    return out, float(b[0])


def chosen_features(sample: DataFrame) -> np.ndarray:
    """The features that ``fit`` may keep: those that go with label 1 in the sample, and the groups' names."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, positive = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for part, text in slices(batch, "t"):
                for y, x in zip(part.column("y").to_pylist(), features(text), strict=True):
                    total[x] += 1
                    if y:
                        positive[x] += 1
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(positive[some])], names=["feature", "total", "positive"])

    rows = sample.mapInArrow(frugal(counted), "feature int, total long, positive long").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"))
    sums = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}  # two rows
    found = rows.filter(F.col("positive") >= LEAST_POSITIVE).toArrow()  # DIMENSIONS rows at most, whatever the corpus
    feature, total, positive = (found.column(c).to_numpy() for c in ("feature", "total", "positive"))
    good = association(positive, total, sums.get(1, 0), sum(sums.values())) >= LEAST_ASSOCIATION
    return np.union1d(feature[good], np.concatenate([np.zeros(0, np.int32), *features(Text(pa.array(sorted(_GROUP_OF))))])).astype(np.int32)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    spark = docs.sparkSession
    own = written(labelled_sample(docs, labels, label_col, id_col, text_col, sample or SAMPLE), "toxic-sample")
    kept = spark.sparkContext.broadcast(chosen_features(own))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = lambda rows: [np.intersect1d(x, kept.value, assume_unique=True).astype(np.int32) for x in rows]
        for batch in batches:
            for part, text in slices(batch, "t"):
                rows = []
                for k, (i, y, w, x) in enumerate(zip(part.column("i").to_pylist(), part.column("y").to_pylist(), part.column("w").to_pylist(), only(features(text)), strict=True)):
                    copies = swapped(text.row(k).decode("utf-8", "replace"))
                    rows.append((i, y, w, x.tobytes(), [z.tobytes() for z in only(features(Text(pa.array(copies, pa.string()))))]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.binary())), strict=True)], names=["i", "y", "w", "x", "swapped"])

    rows = own.mapInArrow(frugal(featured), "i long, y int, w double, x binary, swapped array<binary>").toArrow()  # sum(SAMPLE) rows of chosen features
    rows = rows.sort_by([("i", "ascending"), ("x", "ascending")])
    own_rows = [np.frombuffer(x, np.int32) for x in rows.column("x").to_pylist()]
    pairs = [(k, np.frombuffer(z, np.int32)) for k, copies in enumerate(rows.column("swapped").to_pylist()) for z in copies]
    fitted = fit(own_rows, rows.column("y").to_numpy().astype(np.int64), pairs, penalty, rows.column("w").to_numpy())
    del rows, own_rows, pairs
    kept.unpersist()
    removed(spark, own)
    give_back()
    return fitted


def scores(text: Text, weights: np.ndarray, bias: float) -> np.ndarray:
    rows = Rows(features(text))
    return sigmoid(rows.times(weights) + bias)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, id_col, text_col, penalty=penalty))  # 4 MB
    own = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(scores(text, *shared.value), pa.float64())], names=["i", "score"])

    out = own.mapInArrow(frugal(scored), f"i {own.schema['i'].dataType.simpleString()}, score double")
    return out.select(F.col("i").alias(id_col), fold(F.col("i"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
