"""Quality rules: a plain base, and bands on what public vocabularies make of a text.

Per document: words (``[^\\x20\\x09-\\x0D]+``), their code points, symbols
(``[#*$%&|<>]``), repeated lines, and words inside 8-word windows that occur
twice.  Then the tokens of its words under public vocabularies:

* ``chars_per_token``: code points in words over tokens (fertility, inverted);
* ``fallback_share``: share of tokens that are single bytes, for what the
  vocabulary has no piece;
* ``entropy``: Shannon entropy of the text's tokens over log2 of their number
  (1: no token twice; 0: one token again and again).

A document is rejected where a measure leaves the band of its language, or of
its script where the language has no band.  Scripts are told by lead bytes of
the text itself.

Defined results.  Null or empty text: zeros, null measures, the base fails.  A
long text is measured whole.  Repeated rows count each; empty table: no rows;
a null or unknown language is judged by script; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.llm.kernel import U64, Runs, Text, frugal, mixed, slices, windows, words

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Distinct words whose tokens a worker keeps.
CACHE = 400_000

SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_SCRIPT = np.full(256, -1, np.int8)
# ASCII letters, and lead bytes of UTF-8 by the block they open.
for _name, _ranges in {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)),
    "greek": ((0xCD, 0xCF),),
    "cyrillic": ((0xD0, 0xD4),),
    "hebrew": ((0xD6, 0xD7),),
    "arabic": ((0xD8, 0xDB),),
    "indic": ((0xE0, 0xE1),),
    "kana": ((0xE3, 0xE3),),
    "han": ((0xE4, 0xE9),),
    "hangul": ((0xEA, 0xED),),
    "other": ((0xCB, 0xCC), (0xD5, 0xD5), (0xDC, 0xDF), (0xE2, 0xE2), (0xEE, 0xF4)),
}.items():
    for _a, _b in _ranges:
        _SCRIPT[_a : _b + 1] = SCRIPTS.index(_name)


@dataclass(frozen=True)
class Band:
    """What a document's measures may be; entropy holds from ``entropy_from`` tokens on.

    ``chars_per_token`` is under the vocabulary with byte fallback, ``multi``
    under the one made for many languages.
    """

    chars_per_token: tuple[float, float] = (1.5, 8.0)
    multi: tuple[float, float] = (1.5, 8.0)
    fallback_share: float = 0.05
    entropy: float = 0.35
    entropy_from: int = 40


#: By language code or script; a script without a band takes ``DEFAULT``.  The
#: vocabularies have few pieces past Latin and Cyrillic, so bytes are usual there.
DEFAULT = Band((0.2, 8.0), (0.2, 8.0), 1.0)
BANDS: dict[str, Band] = {
    "en": Band((1.6, 8.0), (1.9, 8.0)),
    "de": Band((1.9, 8.0), (2.0, 8.0)),
    "es": Band((1.6, 8.0), (1.75, 8.0)),
    "fr": Band((1.5, 8.0), (1.7, 8.0)),
    "latin": Band(),
    "greek": Band((0.6, 6.0), (0.3, 6.0), 0.6),
    "cyrillic": Band((1.2, 8.0), (0.8, 8.0), 0.25),
    "han": Band((0.3, 3.0), (0.3, 3.0), 0.9),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINES = np.ones(256, np.uint8)
_LINES[10] = 0


class Vocabulary:
    """Tokens of single words by a sentencepiece model (with bytes for what it lacks) or tiktoken ranks."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = own.vocab_size()
            self.is_byte = np.array([own.is_byte(i) for i in range(self.size)])
            self.encode = lambda texts: own.encode(texts, num_threads=1)
        else:
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self.is_byte = np.zeros(self.size, bool)
            self.is_byte[[v for k, v in ranks.items() if len(k) == 1 and k[0] >= 0x80]] = True
            self.encode = lambda texts: [own.encode_ordinary(f" {t}") for t in texts]
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat, self.at, self.used = np.zeros(1 << 16, np.int32), [0], 0

    def tokens(self, hashes: np.ndarray, word_of) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in ``flat`` of each distinct word's tokens; ``word_of(k)`` is the k-th word's text."""
        if len(self.rows) > CACHE:
            self.clear()
        keys = hashes.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.rows]
        for k, ids in zip(new, self.encode([word_of(k) for k in new]), strict=True):
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.rows[keys[k]] = len(self.at) - 1
            self.at.append(self.used)
        at = np.array(self.at)
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        return at[rows], at[rows + 1]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base(text: Text, runs: Runs, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    n = len(text)
    points = np.concatenate([[0], np.cumsum((text.data & 0xC0) != 0x80)])
    out = {"n_words": runs.counts.astype(np.int64), "word_chars": _row_sums(points[runs.ends] - points[runs.starts], runs.first), "n_symbols": _row_sums(_SYMBOL[text.data], text.offsets)}
    lines = Runs(text, _LINES)
    with_word = np.searchsorted(runs.starts, lines.ends) > np.searchsorted(runs.starts, lines.starts)
    row = lines.row[with_word]
    _, at, times = np.unique(mixed(lines.hashes()[with_word] ^ mixed(row.astype(U64))), return_index=True, return_counts=True)
    out["n_dup_lines"] = np.bincount(row[at], times - 1, n).astype(np.int64)
    value, start, first = windows(hashes, runs.first, WINDOW)
    row = np.repeat(np.arange(n), np.diff(first))
    _, back, times = np.unique(mixed(value ^ mixed(row.astype(U64))), return_inverse=True, return_counts=True)
    again = start[times[back] >= 2]
    cover = np.zeros(len(runs) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = _row_sums(np.cumsum(cover)[:-1] > 0, runs.first)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    return out


def measures(text: Text, runs: Runs, hashes: np.ndarray, own: Vocabulary) -> dict[str, np.ndarray]:
    """Tokens, bytes among them, and relative entropy of each text."""
    n = len(text)
    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    data = text.data.tobytes()
    begin, end = own.tokens(distinct, lambda k: data[runs.starts[at[k]] : runs.ends[at[k]]].decode("utf-8", "replace"))
    length = (end - begin)[back]
    tokens = _row_sums(length, runs.first)
    total = int(length.sum())
    place = np.repeat(begin[back] - (np.cumsum(length) - length), length) + np.arange(total)
    ids = own.flat[place].astype(np.int64)
    row = np.repeat(np.arange(n), tokens)
    fallback = np.bincount(row, own.is_byte[ids], n).astype(np.int64)
    key, times = np.unique(row * own.size + ids, return_counts=True)
    spread = np.bincount(key // own.size, times * np.log2(times), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(tokens) - spread / tokens
        entropy = np.where(tokens > 1, bits / np.log2(tokens), np.nan)
    return {"tokens": tokens, "fallback": fallback, "entropy": np.maximum(entropy, 0.0)}


def scripts(text: Text) -> np.ndarray:
    """The script of most letters of each text, as a place in ``SCRIPTS``; -1 without letters."""
    kind = _SCRIPT[text.data]
    letters = np.flatnonzero(kind >= 0)
    row = np.searchsorted(text.offsets, letters, "right") - 1
    counts = np.bincount(row * len(SCRIPTS) + kind[letters], minlength=len(text) * len(SCRIPTS)).reshape(len(text), -1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), -1)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, fallback_share double, entropy double, multi_chars_per_token double"


def judge(docs: DataFrame, piece_path: str, multi_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] | None = None) -> DataFrame:
    """One row per document: its id, the base counts, the verdict and the measures.

    The band is that of the document's language where there is one, else that
    of its script.
    """
    bands = bands or BANDS
    names = [*SCRIPTS, *sorted(set(bands) - set(SCRIPTS)), "none"]
    known = [bands.get(s, DEFAULT) for s in names]
    low, high, low_multi, high_multi, share, least, since = (np.array(x) for x in zip(*[(*b.chars_per_token, *b.multi, b.fallback_share, b.entropy, b.entropy_from) for b in known], strict=True))
    by_language = {s: k for k, s in enumerate(names) if s in bands}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, multi = vocabulary(piece_path), vocabulary(multi_path)
        for batch in batches:
            for part, text in slices(batch, "t"):
                runs = words(text)
                hashes = runs.hashes()
                out = base(text, runs, hashes)
                m, script = measures(text, runs, hashes, piece), scripts(text)
                with np.errstate(divide="ignore", invalid="ignore"):
                    fertility = out["word_chars"] / m["tokens"]
                    fallback = m["fallback"] / m["tokens"]
                    other = out["word_chars"] / measures_count(text, runs, hashes, multi)
                band = np.array([by_language.get(x, s) for x, s in zip(part.column("l").to_pylist(), script.tolist(), strict=True)])
                within = (fertility >= low[band]) & (fertility <= high[band]) & (other >= low_multi[band]) & (other <= high_multi[band]) & (fallback <= share[band]) & ((m["entropy"] >= least[band]) | (m["tokens"] < since[band]))
                columns = [part.column("i"), *(pa.array(out[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), pa.array(~out["base_failed"] & within), pa.array([None if s < 0 else SCRIPTS[s] for s in script], pa.string())]
                columns += [pa.array(x, pa.float64(), from_pandas=True) for x in (fertility, fallback, m["entropy"], other)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(c.split()[0] for c in SCHEMA.split(", "))])

    language = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    own = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"), language.alias("l"))
    return own.mapInArrow(frugal(judged), f"`{id_col}` {own.schema['i'].dataType.simpleString()}, {SCHEMA}")


def measures_count(text: Text, runs: Runs, hashes: np.ndarray, own: Vocabulary) -> np.ndarray:
    """The number of tokens of each text."""
    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    data = text.data.tobytes()
    begin, end = own.tokens(distinct, lambda k: data[runs.starts[at[k]] : runs.ends[at[k]]].decode("utf-8", "replace"))
    return _row_sums((end - begin)[back], runs.first)
