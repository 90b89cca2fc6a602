"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of ``SPAN`` bytes that cover all of it.  In each
segment one gated recurrent layer runs from the left and one from the right;
at every byte a softmax over both states gives the probabilities of the
languages.  The document's probabilities are the mean over its letters, and
the highest one names the language.

The network is small (two layers of ``WIDTH`` units) and trained in numpy by
backpropagation through time on at most ``DOCUMENTS`` documents of each
language, up to ``SEGMENTS`` segments of each.  Every document is labelled
whole.

Defined results.  Null texts and texts without a letter are ``und`` with score
0.  With one learnt language everything else is that language with score 1;
with none everything is ``und``.  Ties go to the language first by code point.
Repeated rows give a row each and are learnt from once; empty table: no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.llm.kernel import Text, frugal, slices
from tessalith.llm.learning import Adam, fold, place, share_for

SPAN, WIDTH = 48, 8
DOCUMENTS, SEGMENTS = 1200, 3
EPOCHS, BATCH, RATE, SEED = 8, 192, 1e-2, 7
#: Segments that are run at once.
TOGETHER = 4096
NONE = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def segments(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (segments x SPAN), the row of each segment, and which bytes are letters that no earlier segment has.

    The last segment of a text ends where the text ends and overlaps the one
    before; a text shorter than a segment is filled up with spaces.
    """
    size = np.diff(text.offsets)
    n = -(-size // SPAN)
    row = np.repeat(np.arange(len(text)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    fresh = text.offsets[row] + nth * SPAN
    begin = np.maximum(np.minimum(fresh, text.offsets[row + 1] - SPAN), text.offsets[row])
    at = begin[:, None] + np.arange(SPAN)
    inside = at < text.offsets[row + 1][:, None]
    data = np.where(inside, _LOWER[text.data][np.minimum(at, len(text.data) - 1)] if len(text.data) else 0, 32).astype(np.uint8)
    return data, row, inside & (at >= fresh[:, None]) & _LETTER[data]


class Network:
    """``x`` holds each byte's input to the gates (update, reset, new), ``u`` the recurrent weights, both for two directions."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.x = rng.normal(0, 0.3, (2, 3 * WIDTH, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (2, 3 * WIDTH, WIDTH)).astype(np.float32)
        self.v = rng.normal(0, 0.3, (2, len(languages), WIDTH)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def states(self, data: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Both layers' states (2, SPAN, WIDTH, segments), each at its byte's place; ``keep`` collects what training needs."""
        steps, n = data.shape[1], len(data)
        out = np.empty((2, steps, WIDTH, n), np.float32)
        for way in (0, 1):
            h = np.zeros((WIDTH, n), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                gate = np.take(self.x[way], data[:, t], axis=1)
                from_state = self.u[way] @ h
                zr = gate[: 2 * WIDTH]
                zr += from_state[: 2 * WIDTH]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:WIDTH], zr[WIDTH:]
                new = gate[2 * WIDTH :]
                new += r * from_state[2 * WIDTH :]
                np.tanh(new, out=new)
                if keep is not None:
                    keep[way, t] = (h, z, r, new, from_state[2 * WIDTH :])
                h = h - new
                h *= z
                h += new
                out[way, t] = h
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        return np.matmul(self.v[0], states[0]) + np.matmul(self.v[1], states[1]) + self.b

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(SPAN, languages, segments)."""
        z = self.logits(self.states(data))
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def gradients(self, data: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss over the weighted bytes and the gradients of x, u, v and b, by backpropagation through time."""
        keep: dict = {}
        states = self.states(data, keep)
        z = self.logits(states)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        own = weight.T[:, None, :] / max(1.0, weight.sum())
        one = (np.arange(len(self.languages))[:, None] == label)[None]
        loss = -float((np.log(np.maximum(p, 1e-12)) * one * own).sum())
        error = ((p - one) * own).astype(np.float32)
        gx, gu = np.zeros_like(self.x), np.zeros_like(self.u)
        gv = np.stack([np.einsum("tkn,twn->kw", error, states[way], optimize=True) for way in (0, 1)])
        steps = data.shape[1]
        for way in (0, 1):
            dh = np.zeros((WIDTH, len(data)), np.float32)
            inputs = np.empty((steps, 3 * WIDTH, len(data)), np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                before, z, r, new, from_new = keep[way, t]
                dh = dh + self.v[way].T @ error[t]
                to_new = dh * (1 - z) * (1 - new * new)
                to_z = dh * (before - new) * z * (1 - z)
                to_r = to_new * from_new * r * (1 - r)
                inputs[t] = np.concatenate([to_z, to_r, to_new])
                back = np.concatenate([to_z, to_r, to_new * r])
                gu[way] += back @ before.T
                dh = dh * z + self.u[way].T @ back
            flat, values = data.T.ravel(), inputs.transpose(1, 0, 2).reshape(3 * WIDTH, -1)
            gx[way] = np.stack([np.bincount(flat, v, 256) for v in values])
        return loss, [gx, gu, gv, error.sum(axis=(0, 2))[:, None]]

    def train(self, data: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng, adam = np.random.default_rng(seed), Adam([self.x, self.u, self.v, self.b], RATE)
        for epoch in range(epochs):
            adam.rate = RATE * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // BATCH)):
                _, gradients = self.gradients(data[part], label[part], weight[part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
                adam.step([g * min(1.0, 1.0 / (norm + 1e-9)) for g in gradients])

    def pooled(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """For each row the mean probabilities over its letters, and whether it has any."""
        data, row, letters = segments(text)
        total = np.zeros((len(text), len(self.languages)))
        count = np.bincount(row, letters.sum(axis=1), len(text))
        for a in range(0, len(data), TOGETHER):
            b = a + TOGETHER
            sums = np.einsum("tkn,nt->nk", self.probabilities(data[a:b]), letters[a:b].astype(np.float32), optimize=True)
            np.add.at(total, row[a:b], sums)
        return total / np.maximum(count, 1)[:, None], count > 0


def has_letter(text: Text, maybe: np.ndarray) -> np.ndarray:
    """Of the rows in ``maybe`` those with a letter: ASCII ones by bytes, the others asked one by one."""
    out = maybe.copy()
    ascii_letter = _LETTER & (np.arange(256) < 128)
    sums = np.concatenate([[0], np.cumsum(ascii_letter[text.data])])
    for k in np.flatnonzero(maybe & (sums[text.offsets[1:]] == sums[text.offsets[:-1]])):
        out[k] = any(c.isalpha() for c in text.row(k).decode("utf-8", "replace"))
    return out


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, documents: int = DOCUMENTS) -> list:
    """(lang, bytes of its segments) of at most ``documents`` documents of each language, outside the held-out fold."""
    own = docs.select(docs[id_col].cast("string").alias("i"), docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l"))
    own = own.filter(F.col("t").isNotNull() & F.col("l").isNotNull() & ~fold(F.col("i"), 4, 2))
    counts = own.groupBy("l").count().collect()  # a row for each language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("l") == r.l, F.lit(share_for(documents, r["count"]))).otherwise(share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch, "t"):
                data, row, _ = segments(text)
                out = []
                for k, (lang, p) in enumerate(zip(part.column("l").to_pylist(), part.column("p").to_pylist(), strict=True)):
                    mine = np.flatnonzero(row == k)
                    chosen = mine[np.unique(np.linspace(0, len(mine) - 1, min(SEGMENTS, len(mine))).astype(int))] if len(mine) else mine
                    out.append((lang, p, data[chosen].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.binary()), strict=True)], names=["l", "p", "x"])

    sampled = own.withColumn("p", place("i", "t")).filter(F.col("p") < share).select("l", "p", "t")
    # Rows that agree in id and text are one; what is left are little more than ``documents`` small rows a language.
    sampled = sampled.groupBy("l", "p").agg(F.min("t").alias("t"))
    rows = sorted(map(tuple, sampled.mapInArrow(frugal(cut), "l string, p double, x binary").collect()))
    taken: dict[str, int] = {}
    out = []
    for lang, _, x in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= documents:
            out.append((lang, x))
    return out


def fit(rows: list) -> Network:
    """A network from (lang, bytes of segments)."""
    network = Network(sorted({lang for lang, _ in rows}))
    if len(network.languages) > 1:
        label = np.concatenate([[network.languages.index(lang)] * (len(x) // SPAN) for lang, x in rows]).astype(np.int64)
        data = np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(-1, SPAN)
        share = np.bincount(label, minlength=len(network.languages))
        weight = (_LETTER[data] * (share.max() / np.maximum(share, 1))[label][:, None]).astype(np.float32)
        network.train(data, label, weight)
    return network


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    own = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        names = network.languages
        for batch in batches:
            for part, text in slices(batch, "t"):
                if len(names) > 1:
                    mean, some = network.pooled(text)
                else:
                    mean, some = np.ones((len(text), max(1, len(names)))), np.full(len(text), bool(names))
                some = has_letter(text, some & (np.diff(text.offsets) > 0))
                best = mean.argmax(axis=1)
                score = np.where(some, np.clip(mean[np.arange(len(text)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([names[b] if s else NONE for b, s in zip(best, some, strict=True)], pa.string()), pa.array(score, pa.float64())], names=["i", "lang_pred", "score"])

    out = own.mapInArrow(frugal(labelled), f"i {own.schema['i'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("i").alias(id_col), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; languages are learnt from ``lang_col`` outside the held-out fold."""
    network = fit(training_rows(docs, id_col, text_col, lang_col))
    return predict(docs, network, id_col, text_col).select(id_col, fold(F.col(id_col), 4, 2).alias("held_out"), "lang_pred", "score")
