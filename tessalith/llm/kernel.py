"""Vectorised words and hashes over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes, which is the same as on code
points because separators are ASCII.  All functions work on numpy views of the
Arrow buffers; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes that are worked on at once; temporaries are about 40 times that.  A longer text is alone; of it only words cost (8 bytes a word and array).
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IDENTITY = np.arange(256, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, U64), np.ones(n, U64)
    up[1:], down[1:] = U64(_BASE), U64(_BASE_INVERSE)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * SLICE_BYTES, 1 << max(0, n - 1).bit_length())
    return tuple(x[:n] for x in _powers(size))


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of (byte + 1) times a power of its place, from 0."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data) + 1)[0][:-1], out=sums[1:])
    return sums


class Text:
    """Some rows of a string column as bytes: ``data`` and ``offsets`` (one more than rows). Null is empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        self.data = np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])) if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
        self.offsets = o - o[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def plain_sums(self) -> np.ndarray:
        return _sums(self.data)

    @cached_property
    def lower_sums(self) -> np.ndarray:
        return _sums(_LOWER[self.data])

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64 bits for each span (in order of their starts or not): a polynomial of its bytes, then mixed with its length.

        The sums of bytes are made for ``SLICE_BYTES`` at once and only picked at
        the spans' edges, so a long text costs a few numbers a word and none a byte.
        """
        n = len(self.data)
        if n <= SLICE_BYTES:
            sums = self.lower_sums if lower else self.plain_sums
            value = (sums[ends] - sums[starts]) * powers(n + 1)[1][starts]
        else:
            table, at = _LOWER if lower else _IDENTITY, np.concatenate([starts, ends])
            order = np.argsort(at, kind="stable")
            sums, carry, scale = np.zeros(len(at), U64), U64(0), U64(1)
            step = powers(SLICE_BYTES + 1)[0][SLICE_BYTES]
            bounds = np.searchsorted(at[order], np.arange(0, n + SLICE_BYTES, SLICE_BYTES))
            for k, begin in enumerate(range(0, n, SLICE_BYTES)):
                block = _sums(table[self.data[begin : begin + SLICE_BYTES]])
                here = order[bounds[k] : bounds[k + 1]]
                sums[here] = block[at[here] - begin] * scale + carry
                with np.errstate(over="ignore"):  # numbers are modulo 2^64
                    carry, scale = carry + block[-1] * scale, scale * step
            here = order[np.searchsorted(at[order], n) :]
            sums[here] = carry
            # BASE ** -start in two steps: whole slices, then the rest.
            whole, rest = np.divmod(starts, SLICE_BYTES)
            back = powers(SLICE_BYTES + 1)[1]
            slices_back = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n // SLICE_BYTES + 1, back[SLICE_BYTES])]))
            value = (sums[len(starts) :] - sums[: len(starts)]) * slices_back[whole] * back[rest]
        return mixed(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Runs:
    """Maximal runs of bytes of one class (class 0 separates), by row.

    ``starts``/``ends`` are byte positions, ``first`` the index of each row's
    first run (one more than rows), ``row`` the row of each run.
    """

    def __init__(self, text: Text, classes: np.ndarray):
        kind = classes[text.data]
        n = len(kind)
        edge = np.zeros(n + 1, bool)
        edge[text.offsets] = True
        edge[0] = edge[n] = True
        if n:
            edge[1:n] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(edge)
        at = at[: np.searchsorted(at, n) + 1]
        keep = kind[at[:-1]] > 0 if n else np.zeros(0, bool)
        self.text, self.starts, self.ends = text, at[:-1][keep], at[1:][keep]
        self.kind = kind[self.starts]
        self.first = np.searchsorted(self.starts, text.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(text)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.text.span_hashes(self.starts, self.ends, lower)


_WORDS = (~_SEPARATOR).astype(np.uint8)


def words(text: Text) -> Runs:
    return Runs(text, _WORDS)


_TOKENS = _WORDS.copy()
_TOKENS[[c for c in range(128) if _WORDS[c] and not chr(c).isalnum()]] = 2


def word_and_symbol_runs(text: Text) -> Runs:
    """Letters and digits (and all bytes past ASCII) apart from runs of ASCII symbols."""
    return Runs(text, _TOKENS)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows: values, their starting word, and first window of each row."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    value = hashes[: n - width + 1].copy()
    for k in range(1, width):
        value = value * U64(0x9FB21C651E98DF25) + hashes[k : n - width + 1 + k]
    row_end = np.repeat(first[1:], np.diff(first))
    inside = np.flatnonzero(np.arange(n - width + 1) + width <= row_end[: n - width + 1])
    counts = np.maximum(np.diff(first) - width + 1, 0)
    return mixed(value[inside] + U64(width)), inside, np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(runs: Runs, width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """For each row the sorted distinct shingles; with fewer words the whole sequence as one; none without words."""
    h = runs.hashes(lower)
    value, _, first = windows(h, runs.first, width)
    out = []
    for i, n in enumerate(runs.counts):
        if n >= width:
            out.append(np.unique(value[first[i] : first[i + 1]]))
        elif n:
            own = windows(h[runs.first[i] : runs.first[i + 1]], np.array([0, n]), int(n))[0]
            out.append(own)
        else:
            out.append(np.zeros(0, U64))
    return out


def set_digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sorted set of 64-bit values."""
    import xxhash

    return xxhash.xxh3_128_digest(np.ascontiguousarray(values).tobytes())


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(task):
    """A batch function whose worker gives its memory back at the end: Spark keeps workers for later tasks of any kind."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """Parts of a batch whose texts are about ``limit`` bytes together; a longer text is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, "right")))
        part = batch.slice(begin, end - begin)
        yield part, Text(part.column(column))
        begin = end
