"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

Strings are sequences of words: runs of letters and digits of any script,
lower-cased; in scripts without spaces every letter is a word.  The CGK random
walk (Chakraborty, Goldenberg, Koucky 2016) maps a string to one of three times
its length: at step j it emits the word under its head, and a random bit of
(j, word) says whether the head moves.  Two strings at a small edit distance
then agree, with constant probability, in all but few places: Hamming distance
stands for edit distance.

1. A benchmark item is embedded by ``WALKS`` walks, and for each walk ``SAMPLES``
   times a few places of the embedding are sampled into a key (repeated bit
   sampling; ``tests`` hold the recall at all rates of edits allowed).
2. A document is read in windows of each item's size, one from every word.
   Windows with too many word pairs that no item has are left out first: an
   edit makes at most two pairs foreign, so they are too far from every item
   (exact, nothing is lost).
   The others are embedded by the same walks and looked up by their keys.
3. A hit says which item might stand where.  It is verified: the item's words
   against the words around it, by semi-global edit distance.  A match has at
   most ``MAX_RATE`` edits per item word.

The benchmark is the query set: it is read in blocks of about
``CHARACTERS_AT_ONCE``, each small enough to send to all workers, and each is
held against all documents.

Defined results.  Null or empty texts and items match nothing.  Items with
fewer words than ``SHORT`` must occur word for word, as whole word sequences.
Long texts are read whole.  Repeated documents and repeated items each give
their rows.  Empty tables give no rows.  Only id and text columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.llm.kernel import U64, Runs, Text, frugal, mixed, slices

#: Embeddings, keys sampled from each, and places in a key.
WALKS, SAMPLES, PLACES = 8, 8, 2
#: Places of windows' embeddings that are held at once, for each walk.
EMBEDDED = 200_000
#: Edits per word of the item that a match may have, and words below which none are allowed.
MAX_RATE, SHORT = 0.2, 8
#: Characters of the benchmark that are sent to all workers at once (about 25 times as many bytes).
CHARACTERS_AT_ONCE = 1_000_000
SEED = 0x5DEECE66D


def embed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    """The first places of the CGK embeddings of ``words[s : s + size]`` (steps x walks x windows); 0 past the end."""
    head = np.zeros((WALKS, len(starts)), np.int64)
    out = np.empty((steps, WALKS, len(starts)), U64)
    walk = np.array([SEED * (w + 1) % 2**64 for w in range(WALKS)], U64)[:, None]
    for step in range(steps):
        inside = head < sizes
        out[step] = np.where(inside, words[starts + np.minimum(head, sizes - 1)], U64(0))
        head += inside & (mixed(out[step] ^ (walk + U64(step * 0x9E3779B97F4A7C15 % 2**64))) >> U64(63) > 0)
    return out


@lru_cache(maxsize=10_000)
def sampled_places(size: int) -> np.ndarray:
    """For each key of each walk the places it samples (walks x samples x places), the same on both sides.

    A head moves at every second step on average, so past ``1.5 * size`` steps
    an embedding is mostly padding, which all strings share.
    """
    rng = np.random.default_rng([SEED, size])
    span = max(PLACES, size * 3 // 2)
    return np.array([[sorted(rng.choice(span, PLACES, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)])


def keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows and their LSH keys (which tell size, walk and sample too), by parts of bounded memory; keys that hold padding only are left out."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        steps = max(PLACES, int(sizes[order[at]]) * 3 // 2)
        some = order[at : at + max(1, EMBEDDED // steps)]
        some = some[sizes[some] == sizes[some[0]]] if steps > 200 else some
        at += len(some)
        own = sizes[some]
        distinct, back = np.unique(own, return_inverse=True)
        places = np.stack([sampled_places(int(x)) for x in distinct])[back]
        symbols = embed(words, starts[some], own, int(places.max()) + 1)
        number = np.arange(WALKS * SAMPLES).reshape(1, WALKS, SAMPLES).astype(U64)
        key = mixed(own.astype(U64))[:, None, None] + number
        held = np.zeros(key.shape, np.int64)
        for p in range(PLACES):
            symbol = symbols[places[..., p], np.arange(WALKS)[None, :, None], np.arange(len(some))[:, None, None]]
            key = mixed(key * U64(0x9FB21C651E98DF25) + symbol)
            held += symbol != 0
        valid = held >= np.minimum(2, own)[:, None, None]
        yield np.broadcast_to(some[:, None, None], key.shape)[valid], key[valid]


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The fewest edits that make ``item`` a part of ``text``, and that part's begin and end.

    Sellers' recurrence; along a row the insertion closure is a running
    minimum, so each row is a few vector operations.
    """
    n = len(text)
    place = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), place.copy()
    for k, word in enumerate(item.tolist()):
        up, diagonal = cost + 1, np.empty(n + 1, np.int64)
        diagonal[0] = k + 1
        diagonal[1:] = cost[:-1] + (text != word)
        own, from_ = np.minimum(up, diagonal), begin.copy()
        better = diagonal < up
        better[0] = False
        from_[1:][better[1:]] = begin[:-1][better[1:]]
        shifted = own - place
        best = np.minimum.accumulate(shifted)
        last = np.maximum.accumulate(np.where(shifted == best, place, 0))
        cost, begin = best + place, from_[last]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Members:
    """A set of 64-bit values: a bitmap turns most others away, the sorted values decide."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = min(22, max(8, int(len(self.values)).bit_length() + 5))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.values >> U64(64 - self.bits)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.map[values >> U64(64 - self.bits)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, values[maybe]), len(self.values) - 1)
            out[maybe] = self.values[at] == values[maybe]
        return out


def pairs(words: np.ndarray) -> np.ndarray:
    """A value for each two neighbouring words."""
    return mixed(words[:-1] * U64(0x9FB21C651E98DF25) + words[1:])


class Items:
    """A block of the benchmark, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], max_rate: float):
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        self.limit = [int(max_rate * len(w)) if len(w) >= SHORT else 0 for w in self.words]
        self.pairs = Members(np.concatenate([np.zeros(0, U64), *map(pairs, self.words)]))
        self.own_pairs = Members(np.concatenate([np.zeros(0, U64), *(pairs(w) ^ mixed(np.array([k], U64)) for k, w in enumerate(self.words))]))
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by_size.setdefault(len(w), []).append(k)
        self.tables = []
        for size, items in sorted(by_size.items()):
            # An edit makes two pairs foreign, and a window begins at a word of the match or next to it.
            spare = 2 * int(max_rate * size) + 2 if size >= SHORT else 0
            self.tables.append((size, spare, Members(np.concatenate([np.zeros(0, U64), *(pairs(self.words[k]) for k in items)]))))
        sizes = np.array([len(w) for w in self.words], np.int64)
        found = list(keys(np.concatenate([np.zeros(0, U64), *self.words]), np.cumsum(sizes) - sizes, sizes))
        item, key = (np.concatenate([np.zeros(0, x), *c]) for x, c in zip((np.int64, U64), zip(*found, strict=True) if found else ((), ()), strict=True))
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]

    def hits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows of (document, item, where the item would begin), sorted, once each."""
        if not len(words):
            return np.zeros((0, 3), np.int64)
        two = pairs(words)
        native = np.flatnonzero(self.pairs.has(two))
        known = np.zeros(len(words) + 1, np.int32)
        known[native + 1] = 1
        known = np.cumsum(known, dtype=np.int32)
        row_end = np.repeat(first[1:], np.diff(first))
        starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, spare, members in self.tables:
            if len(words) < size:
                continue
            n = len(words) - size + 1
            start = np.flatnonzero(known[size - 1 :][:n] - known[:n] >= size - 1 - spare)
            if len(start):  # the same for pairs of the items of this size
                own = native[members.has(two[native])]
                start = start[np.searchsorted(own, start + size - 1) - np.searchsorted(own, start) >= size - 1 - spare]
            start = start[start + size <= row_end[start]]
            starts.append(start)
            sizes.append(np.full(len(start), size))
        start, size = np.concatenate(starts), np.concatenate(sizes)
        out = [np.zeros((0, 3), np.int64)]
        for window, key in keys(words, start, size):
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            n = high - low
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window = np.repeat(window, n)
            out.append(np.unique(np.stack([start[window], self.item[entry], size[window]], axis=1), axis=0))
        found = np.unique(np.concatenate(out), axis=0)
        # The same bound on foreign pairs, for the item that was hit.
        at, item, size = found.T
        code, shared = mixed(item.astype(U64)), np.zeros(len(found), np.int64)
        for j in range(int(size.max(initial=1)) - 1):
            inside = np.flatnonzero(j < size - 1)
            shared[inside] += self.own_pairs.has(two[at[inside] + j] ^ code[inside])
        spare = np.zeros(int(size.max(initial=0)) + 1, np.int64)
        for s, x, *_ in self.tables:
            if s < len(spare):
                spare[s] = x
        spare = spare[size]
        near = shared >= size - 1 - spare
        at, item = at[near], item[near]
        out = np.stack([np.searchsorted(first, at, "right") - 1, item, at], axis=1)
        return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, place of the item, first word, word past the last, edits): what is found does not overlap."""
        hits = self.hits(words, first)
        if not len(hits):
            return
        limit = np.array(self.limit)[hits[:, 1]]
        apart = np.ones(len(hits), bool)
        apart[1:] = (hits[1:, :2] != hits[:-1, :2]).any(axis=1) | (hits[1:, 2] - hits[:-1, 2] > limit[1:] + 1)
        begins = np.flatnonzero(apart)
        for a, b in zip(begins, [*begins[1:], len(hits)], strict=True):
            row, item, at = hits[a].tolist()
            own, most = self.words[item], self.limit[item]
            regions = [(max(int(first[row]), at - most), min(int(first[row + 1]), int(hits[b - 1, 2]) + len(own) + most))]
            while regions:
                low, high = regions.pop()
                here = words[low:high]
                if high - low < len(own) - most:
                    continue
                cost, begin, end = edits(own, here)
                if cost <= most and end > begin:
                    yield row, item, low + begin, low + end, cost
                    regions += [(low, low + begin), (low + end, high)]


@lru_cache(maxsize=1)
def _script_classes() -> np.ndarray:
    """For each code point: 0 no word, 1 letter or digit, 2 letter of a script that is written without spaces."""
    out = np.array([chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)]).astype(np.uint8)
    for a, b in _UNSPACED:
        out[a:b] *= 2
    return out


# Blocks of scripts that are written without spaces (Thai to Lao, Myanmar, Khmer, kana, Han).
_UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x32000))
_ASCII_WORD = np.array([chr(c).isalnum() for c in range(128)] + [False] * 128).astype(np.uint8)
_EXTRA = np.zeros(256, np.int64)
_EXTRA[0xC0:0xE0], _EXTRA[0xE0:0xF0], _EXTRA[0xF0:] = 1, 2, 3


class _Kinds:
    """Classes of a text's bytes, as ``Runs`` asks for them."""

    def __init__(self, kind: np.ndarray):
        self.kind = kind

    def __getitem__(self, _: np.ndarray) -> np.ndarray:
        return self.kind


def normal_words(text: Text) -> tuple[Runs, np.ndarray]:
    """Letter and digit runs, lower-cased, of any script; a letter of a script without spaces is a run of its own."""
    data = text.data
    kind = _ASCII_WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        extra = _EXTRA[data[lead]]
        point = data[lead].astype(np.int64) & (0x3F >> extra)
        for k in (1, 2, 3):
            more = extra >= k
            point[more] = point[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
        own = _script_classes()[np.minimum(point, 0x10FFFF)]
        alone = own == 2
        own[alone] = 2 + np.cumsum(alone)[alone] % 2  # neighbours differ, so each is a run
        for k in range(4):
            more = extra >= k
            kind[np.minimum(lead[more] + k, len(data) - 1)] = own[more]
    runs = Runs(text, _Kinds(kind))
    return runs, runs.hashes(lower=True)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_rate: float = MAX_RATE, at_once: int = CHARACTERS_AT_ONCE) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start_word, end_word (in the document's normal words), edits."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_id].cast("long").alias("i"), benchmark[item_text].cast("string").alias("t")).filter("t is not null")
    characters = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-characters // at_once)
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    own = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"))
    schema = "doc_id long, item_id long, start_word long, end_word long, edits long"
    out = None
    for k in range(blocks):
        part = own.mapInArrow(frugal(_finder(spark, items.filter(block == k).toArrow(), max_rate)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[list, Runs, np.ndarray]]:
    batch = pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_lower(batch.column(1))], names=["i", "t"])
    for part, text in slices(batch, "t"):
        yield part.column("i").to_pylist(), *normal_words(text)


def _finder(spark, rows: pa.Table, max_rate: float):
    items = []
    for batch in rows.to_batches():
        for ids, runs, hashes in _parsed(batch):
            items += [(i, hashes[a:b]) for i, a, b in zip(ids, runs.first, runs.first[1:], strict=False) if b > a]
    shared = spark.sparkContext.broadcast(Items(items, max_rate))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, runs, hashes in _parsed(batch):
                out = [(docs[row], shared.value.ids[item], begin - int(runs.first[row]), end - int(runs.first[row]), cost) for row, item, begin, end, cost in shared.value.matches(hashes, runs.first)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "edits"])

    return found
