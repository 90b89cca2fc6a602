"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

1. Random indexing.  Every word hashes into one of ``BUCKETS`` rows.  A row's
   index vector is a fixed sparse ternary vector; its context vector is the sum
   of the index vectors of the words within ``REACH`` places, over the whole
   corpus.  The table has a fixed size (2 MB) however large the corpus: tasks
   add up their own texts, and the tables are summed in two steps of bounded
   groups.  Words are runs of letters and digits, or of symbols, case kept.
2. Pooling.  A document is the mean and the spread of its words' vectors, and
   the mean product of neighbours' vectors (high where words repeat).
3. A network of two layers in numpy, trained by Adam on at most
   ``sum(SAMPLE)`` labelled documents; a fifth of them is kept aside for the
   temperature by which its logits are divided.  The classes' share, which
   shifts the logits, is that of all labelled documents, and the documents kept
   aside weigh accordingly: the sample's own share depends on its caps.

Defined results.  Null and empty texts pool to zeros and get that point's
score.  Without labels of both classes every score is the share of label 1
(0.5 without any).  Repeated rows count each; empty table: no rows; columns
besides id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessalith.llm.kernel import Text, frugal, give_back, slices, word_and_symbol_runs
from tessalith.llm.learning import Adam, fold, labelled_sample, sigmoid, temperature

BUCKETS, WIDTH, NONZERO, REACH = 1 << 13, 32, 4, 2
BLOCKS = 16
HIDDEN, EPOCHS, BATCH = 32, 60, 128
#: Labelled documents of each class that are learnt from at most.
SAMPLE = {0: 10_000, 1: 10_000}
SEED = 20_240_611


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its nonzero entries."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO].astype(np.int64)
    return places, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def buckets(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the first word of each row."""
    runs = word_and_symbol_runs(text)
    return (runs.hashes() % np.uint64(BUCKETS)).astype(np.int64), runs.first


def add_contexts(table: np.ndarray, bucket: np.ndarray, first: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    row_end = np.repeat(first[1:], np.diff(first))
    for reach in range(1, REACH + 1):
        a = np.flatnonzero(np.arange(len(bucket)) + reach < row_end)
        for own, other in ((bucket[a], bucket[a + reach]), (bucket[a + reach], bucket[a])):
            flat = own[:, None] * WIDTH + places[other]
            table += np.bincount(flat.ravel(), signs[other].ravel(), BUCKETS * WIDTH).astype(np.int64)


def corpus_contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context table of all texts."""
    tasks = docs.rdd.getNumPartitions()
    group = max(8, math.isqrt(tasks))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, signs = index_vectors()
        table = np.zeros(BUCKETS * WIDTH, np.int64)
        for batch in batches:
            for _, text in slices(batch, "t"):
                add_contexts(table, *buckets(text), places, signs)
        if table.any():
            parts = table.astype(np.int32 if np.abs(table).max() < 2**31 else np.int64).reshape(BLOCKS, -1)
            salt = TaskContext.get().partitionId() // group
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array([parts.itemsize] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts])], names=["block", "salt", "item", "sums"])

    def summed(rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x, f"<i{n}").astype(np.int64) for x, n in zip(rows.column("sums").to_pylist(), rows.column("item").to_pylist(), strict=True)), np.zeros(BUCKETS * WIDTH // BLOCKS, np.int64))
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "item": pa.array([8], pa.int32()), "sums": [total.tobytes()]})

    schema = "block int, salt int, item int, sums binary"
    parts = docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(frugal(counted), schema)
    parts = parts.groupBy("block", "salt").applyInArrow(summed, schema).groupBy("block").applyInArrow(summed, schema)
    table = np.zeros((BLOCKS, BUCKETS * WIDTH // BLOCKS), np.int64)
    for row in parts.collect():  # BLOCKS rows of fixed size
        table[row.block] = np.frombuffer(row.sums, "<i8")
    return table.reshape(BUCKETS, WIDTH)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Contexts less what any word would have by the corpus' mean, at unit length."""
    weight = np.abs(contexts).sum(axis=1, keepdims=True).astype(np.float64)
    mean = contexts.sum(axis=0) / max(1.0, weight.sum())
    own = contexts - weight * mean
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    return (own / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: Text, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread, and neighbours' product of each row's word vectors."""
    bucket, first = buckets(text)
    n = np.diff(first)
    out = np.zeros((len(text), 3 * WIDTH), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    v = vectors[bucket]
    count = n[full][:, None]
    mean = np.add.reduceat(v, first[full], axis=0) / count
    product = np.zeros_like(v)
    product[:-1] = v[:-1] * v[1:]
    product[first[1:][full] - 1] = 0  # the last word of a row has no neighbour
    out[full, :WIDTH] = mean
    out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(v * v, first[full], axis=0) / count - mean * mean, 0))
    out[full, 2 * WIDTH :] = np.add.reduceat(product, first[full], axis=0) / np.maximum(count - 1, 1)
    return out


class Network:
    """tanh layer, linear layer, temperature; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, stands_for: np.ndarray | None = None, seed: int = SEED):
        """Rows, labels and how many labelled rows each row stands for (one by default)."""
        stands_for = np.ones(len(y)) if stands_for is None else stands_for
        share = float(y.mean()) if len(y) else 0.5
        self.constant = share if len(np.unique(y)) < 2 else None
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = ((x - self.mean) / self.scale).astype(np.float64)
        order = rng.permutation(len(y))
        aside, own = order[: len(y) // 5], order[len(y) // 5 :]
        self.w1, self.b1 = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        adam = Adam([self.w1, self.b1, self.w2, self.b2], 3e-3)
        weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
                h = np.tanh(x[part] @ self.w1 + self.b1)
                error = weight[part] * (sigmoid(h @ self.w2 + self.b2) - y[part]) / len(part)
                back = error[:, None] * self.w2 * (1 - h * h)
                adam.step([x[part].T @ back + 1e-4 * self.w1, back.sum(axis=0), h.T @ error + 1e-4 * self.w2, np.array([error.sum()])])
        # Balanced in training; the prior comes back as a shift of the logit.
        share = float(np.average(y, weights=stands_for))
        self.shift, self.temperature = math.log(share / (1 - share)), 1.0
        logits = np.tanh(x[aside] @ self.w1 + self.b1) @ self.w2 + self.b2
        self.temperature = temperature(logits + self.shift, y[aside], stands_for[aside])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return sigmoid((h @ self.w2 + self.b2 + self.shift) / self.temperature)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None) -> tuple[np.ndarray, Network]:
    """Word vectors of the corpus and the network on them."""
    vectors = word_vectors(corpus_contexts(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), part.column("w"), pa.array([x.tobytes() for x in pooled(text, shared.value)], pa.binary())], names=["i", "y", "w", "x"])

    rows = labelled_sample(docs, labels, label_col, id_col, text_col, sample or SAMPLE).mapInArrow(frugal(features), "i long, y int, w double, x binary").toArrow()  # sum(SAMPLE) rows of 384 bytes
    rows = rows.sort_by([("i", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, 3 * WIDTH)
    network = Network(x, rows.column("y").to_numpy().astype(np.int64), rows.column("w").to_numpy())
    del rows, x
    give_back()
    return vectors, network


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns (by default the id) and the score under ``name``, for all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(keep or [id_col])
    read = columns if text_col in columns else [*columns, text_col]
    own = docs.select(*[(docs[c].cast("string") if c == text_col else docs[c]).alias(f"c{k}") for k, c in enumerate(read)])
    place = read.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for part, text in slices(batch, f"c{place}"):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(network.scores(pooled(text, vectors)), pa.float64())], names=[*part.schema.names[: len(columns)], "score"])

    schema = StructType([*own.schema.fields[: len(columns)], StructField("score", DoubleType())])
    out = own.mapInArrow(frugal(scored), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs, train(docs, labels, label_col, id_col, text_col), id_col, text_col)
    return scored.select(id_col, fold(F.col(id_col), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
