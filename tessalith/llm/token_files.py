"""Token-id files compressed with one zstandard dictionary.

A dataset is a folder:

``dictionary.zdict``
    the shared dictionary, trained on the serialised ids of a bounded sample;
``shard-NNNNNNNNNNNN.ids``
    a header (magic, version, xxh3-64 of the dictionary), one zstandard frame
    per document in ascending ``doc_id`` (or in a given order), an index with for each document
    ``doc_id, n_tokens, frame offset, frame length`` (four little-endian
    int64), and a footer (index offset, documents, tokens, magic).

A frame holds the document's ids, each as a little-endian unsigned 32-bit
integer, the end id included.  One document is read by its index entry and one
frame: nothing before it is decompressed.

Defined results.  Null text: the end id alone.  Repeated ``doc_id``: every row
is kept, ordered by a hash of the text among equal ``doc_id``.  Empty table: a
dictionary of no bytes and no shard.  Columns besides id, text and the one that
orders the documents (``order``, where it is not the id) are ignored.
A null ``doc_id`` sorts first and is stored as the smallest int64.  The literal
of an added token (``<|endoftext|>``) in a text becomes that token's id, as the
library has it without settings, or with ``added_tokens=False`` is text like any other.
"""

from __future__ import annotations

import bisect
import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessalith.llm.kernel import U64, Text, frugal, give_back, slices, words
from tessalith.llm.learning import place, share_for
from tessalith.llm.storage import new_path, partitions_for

MAGIC = b"TSLIDS01"
HEADER = struct.Struct("<8sQ")
FOOTER = struct.Struct("<qqq8s")
NULL_ID = -(1 << 63)
END_ID = 0
#: The dictionary is trained on at most so many documents and bytes of ids of each.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8192, 64 << 10
#: Distinct pieces whose ids a worker keeps (about 40 bytes each), and those in the young array.
CACHE, YOUNG = 500_000, 100_000
LAST_LATIN = "\u024f"
#: Bytes of input that become one shard, about.
SHARD_INPUT = 16 << 20
#: A shard is closed beyond so many bytes; a range has at most ``ROLLS`` shards.
SHARD_BYTES, ROLLS = 64 << 20, 1_000_000
#: Ranges of documents at most (each of several shards then), and keys that are drawn for a range to find their bounds.
RANGES, KEYS_DRAWN = 20_000, 20
#: Bytes of text that are encoded at once.
BATCH_BYTES = 1 << 19
LEVEL = 1

def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a folder's URI names; a plain path is local."""
    if urlparse(uri).scheme:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def put(uri: str, data: list[bytes]) -> None:
    """Write a file whole: under another name, then moved, so that a task that runs twice leaves one good file."""
    fs, path = filesystem(uri)
    draft = f"{path}.{os.getpid()}-{os.urandom(6).hex()}"
    with fs.open_output_stream(draft) as out:
        for x in data:
            out.write(x)
    fs.move(draft, path)


class _Places:
    """Hashes of pieces and their places in an encoder's table, as sorted arrays: a small young one and a large old one."""

    def __init__(self):
        self.levels = [(np.zeros(0, U64), np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for known, place in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, place[at], out)
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        young, old = self.levels
        young = self._merged(young, (keys, places))
        self.levels = [(np.zeros(0, U64), np.zeros(0, np.int64)), self._merged(old, young)] if len(young[0]) > YOUNG else [young, old]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]


class _Growing:
    """An array with room at its end."""

    def __init__(self, kind: str):
        self.room, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(max(len(self.room) // 2, len(values)), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


#: What stands before a word: nothing, a space, a newline.
_BEFORE = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], U64)
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
# The white space past ASCII, as UTF-8.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def irregular(text: Text) -> np.ndarray:
    """Rows with white space other than single spaces and newlines between visible characters."""
    data, n = text.data, len(text.data)
    bad = _ODD[data]
    space = (data == 0x20) | (data == 0x0A)
    bad[1:] |= space[1:] & space[:-1]
    edges = np.concatenate([text.offsets[:-1], text.offsets[1:] - 1])[np.tile(np.diff(text.offsets) > 0, 2)]
    bad[edges[space[edges]]] = True
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        following = [data[np.minimum(lead + k, n - 1)] for k in (0, 1, 2)]
        for code in _WIDE_SPACES:
            same = np.logical_and.reduce([following[k] == c for k, c in enumerate(code)])
            bad[lead[same]] = True
    out = np.zeros(len(text), bool)
    out[np.searchsorted(text.offsets, np.flatnonzero(bad), "right") - 1] = True
    return out


class Encoder:
    """Ids of texts by a tokenizers file, word by word.

    A byte-level vocabulary cuts a text before every single space or newline
    that stands between two visible characters, whatever surrounds them; so
    there the ids of a text are those of its pieces (a word and what stands
    before it), one after another.  Pieces repeat much more than texts: each is
    encoded once, its ids stay in a table under its 64-bit hash, and the ids of
    whole batches are gathered from there.  A text with any other white space,
    or with the literal of an added token that counts as such, is encoded in
    one go.
    """

    def __init__(self, path: str, added_tokens: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        self.alphabet = byte_alphabet()
        dot, comma, self.newline = self.direct([".", ",", "\n"])
        self.marks = {".": dot, ",": comma}
        self.forget()

    def forget(self) -> None:
        self.places, self.flat, self.bounds = _Places(), _Growing("<u4"), _Growing("<i8")
        self.bounds.extend(np.zeros(1, np.int64))

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, pieces: list[tuple[int, str]]) -> list[list[int]]:
        """Ids of words behind nothing (0), a space (1) or a newline (2).

        A word of letters, with a space before it or not, goes to the model in
        one piece; so the model is asked at once.  Letters past Latin go
        through the whole tokenizer, whose Unicode tables may be other than
        Python's.
        """
        out: list = [None] * len(pieces)
        rest, model, alphabet = [], self.tokenizer.model, self.alphabet
        for k, (before, word) in enumerate(pieces):
            if word.isalpha() and (word.isascii() or max(word) <= LAST_LATIN):
                plain = word if word.isascii() else word.encode().decode("latin-1").translate(alphabet)
                ids = [t.id for t in model.tokenize(alphabet[32] + plain if before == 1 else plain)]
                out[k] = self.newline + ids if before == 2 else ids
            else:
                rest.append(k)
        for k, ids in zip(rest, self.direct([("", " ", "\n")[pieces[k][0]] + pieces[k][1] for k in rest]), strict=True):
            out[k] = ids
        return out

    def learn(self, pieces: list[tuple[int, str]], stems: list[int]) -> None:
        """Append the ids of new pieces to the table.

        A letter or digit and a full stop or comma behind it are never in one
        token, so a word that ends so is its stem and the mark; ``stems`` has
        the place of each piece's stem where that is known from before, or -1.
        """
        own: dict[tuple[int, str], list[int] | None] = {}
        short = [(k, w[:-1]) if w[-1] in ".," and w[-2:-1].isalnum() else (k, w) for k, w in pieces]
        for stem, place, (_, w) in zip(short, stems, pieces, strict=True):
            if place >= 0 and len(stem[1]) < len(w) and own.get(stem) is None:
                own[stem] = self.flat.room[self.bounds.room[place] : self.bounds.room[place + 1]].tolist()
            own.setdefault(stem)
        new = [stem for stem, ids in own.items() if ids is None]
        own.update(zip(new, self.piece_ids(new), strict=True))
        ids = [own[stem] if len(stem[1]) == len(w) else own[stem] + self.marks[w[-1]] for stem, (_, w) in zip(short, pieces, strict=True)]
        self.bounds.extend(self.flat.n + np.cumsum(list(map(len, ids)), dtype=np.int64))
        self.flat.extend(np.fromiter(itertools.chain.from_iterable(ids), "<u4"))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers, the end id included."""
        if len(self.places) > CACHE:
            self.forget()
        text = Text(column)
        runs, odd, end = words(text), irregular(text), np.array([END_ID], "<u4")
        for literal in self.literals:
            odd |= pc.fill_null(pc.match_substring(column, literal), False).to_numpy(zero_copy_only=False)
        fine = np.flatnonzero(~odd[runs.row])
        starts, ends = runs.starts[fine], runs.ends[fine]
        first = text.offsets[runs.row[fine]] == starts
        before = np.where(first, 0, np.where(text.data[starts - 1] == 0x20, 1, 2))
        distinct, at, back = np.unique(text.span_hashes(starts, ends) ^ _BEFORE[before], return_index=True, return_inverse=True)
        place = self.places.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            a, b, kind = starts[at[new]], ends[at[new]], before[at[new]]
            marked = ((text.data[b - 1] == 0x2E) | (text.data[b - 1] == 0x2C)) & (b - a > 1)
            stems = np.where(marked, self.places.find(text.span_hashes(a, b - marked) ^ _BEFORE[kind]), -1)
            place[new] = self.bounds.n - 1 + np.arange(len(new))
            self.places.add(distinct[new], place[new])
            data = text.data.tobytes()
            self.learn([(k, data[x:y].decode("utf-8", "replace")) for x, y, k in zip(a.tolist(), b.tolist(), kind.tolist(), strict=True)], stems.tolist())
        bounds = self.bounds.values
        length = (bounds[place + 1] - bounds[place])[back]
        total = np.cumsum(length)
        ids = self.flat.values[np.repeat(bounds[place][back] - (total - length), length) + np.arange(total[-1] if len(total) else 0)]
        at = np.concatenate([[0], np.cumsum(np.bincount(runs.row[fine], length, len(text)).astype(np.int64))])
        whole = {k: np.array(i, "<u4") for k, i in zip(np.flatnonzero(odd).tolist(), self.direct([text.row(k).decode("utf-8", "replace") for k in np.flatnonzero(odd)]), strict=True)}
        return [np.concatenate([whole[k] if k in whole else ids[at[k] : at[k + 1]], end]) for k in range(len(text))]


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool = True) -> Encoder:
    """One encoder a process: Spark reuses a worker for many tasks, and its known pieces stay."""
    return Encoder(path, added_tokens)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for part, _ in slices(batch, "t", BATCH_BYTES):
        yield part, part.column("t")


def train_dictionary(docs: DataFrame, tokenizer_path: str, documents: int, added_tokens: bool = True) -> bytes:
    """A dictionary from the ids of at most ``SAMPLE_DOCUMENTS`` of the rows (i, t), the ones that hash lowest.

    The sample bounds what the driver holds (16 MB) and only changes how small
    the frames get, never what is read back.  Rows with equal texts count once.
    """
    begin = F.left(F.coalesce("t", F.lit("")), F.lit(SAMPLE_BYTES))
    near = docs.select(place("i", "t").alias("p"), begin.alias("t")).filter(F.col("p") < share_for(SAMPLE_DOCUMENTS, documents))
    rows = near.groupBy("p").agg(F.min("t").alias("t")).collect()  # about SAMPLE_DOCUMENTS
    rows = sorted(rows, key=lambda r: (r.p, r.t))[:SAMPLE_DOCUMENTS]
    texts = pa.RecordBatch.from_arrays([pa.array([r.t for r in rows], pa.string())], names=["t"])
    samples = [x.tobytes()[:SAMPLE_BYTES] for _, part in _texts(texts) for x in encoder(tokenizer_path, added_tokens).encode(part) if len(x) > 1]
    encoder.cache_clear()  # the driver needs its table no more
    give_back()
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: frames then go without a dictionary
        return b""


def range_bounds(docs: DataFrame, documents: int) -> list[tuple[int, int, int]]:
    """Keys (place, tie, salt) that cut rows with these columns into ranges of about ``SHARD_INPUT`` bytes, from a bounded sample of keys."""
    n = min(partitions_for(docs, SHARD_INPUT), RANGES)
    keys = docs.select("place", "tie", "salt")
    near = F.pmod(F.xxhash64("place", "tie", "salt"), F.lit(1 << 30)) / float(1 << 30)
    drawn = sorted(map(tuple, keys.filter(near < share_for(n * KEYS_DRAWN, documents)).collect()))
    return sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if len(drawn) >= n else sorted(set(drawn[1:]))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True, order: Column | None = None) -> DataFrame:
    """Encode ``docs`` into ``folder``; returns the manifest: shard, n_docs, n_tokens, one row per shard.

    One pass encodes and compresses; the compressed frames (smaller than the
    texts) are range-partitioned once by ``order`` (a long; the id by default),
    and each range becomes a shard.  Rows of one place are told apart by a hash
    of the text, and equal ones by a salt, so that a hot id is cut into ranges
    too.
    """
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[id_col].cast("long") if order is None else order, F.lit(NULL_ID)).alias("place"), F.xxhash64(text).alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), text.alias("t"))
    documents = docs.count()
    dictionary = train_dictionary(own.select("i", "t"), tokenizer_path, documents, added_tokens)
    put(f"{folder}/dictionary.zdict", [dictionary])
    shared = spark.sparkContext.broadcast(dictionary)
    bounds = range_bounds(own, documents)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, added_tokens).encode
        extra = {"dict_data": zstandard.ZstdCompressionDict(shared.value)} if shared.value else {}
        press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **extra)
        for part in (p for b in batches for p, _ in slices(b, "t", BATCH_BYTES)):
            raw = [x.tobytes() for x in encode(part.column("t"))]
            key = [part.column(c) for c in ("place", "tie", "salt")]
            ranges = [bisect.bisect_right(bounds, k) for k in zip(*(c.to_pylist() for c in key), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), *key, pc.fill_null(part.column("i"), NULL_ID), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([press.compress(x) for x in raw], pa.binary())],
                names=["part", "place", "tie", "salt", "doc_id", "n_tokens", "frame"],
            )

    frames = own.mapInArrow(frugal(encoded), "part int, place long, tie long, salt long, doc_id long, n_tokens long, frame binary")
    # Ranges by known bounds: repartitionByRange would encode everything once more to sample it.
    ranged = frames.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("place", "tie", "salt").select("doc_id", "n_tokens", "frame")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, roll, done = TaskContext.get().partitionId(), 0, []
        out = None
        for batch in batches:
            for i, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or Writer(folder, part * ROLLS + roll, xxhash.xxh3_64_intdigest(shared.value))
                out.add(i, n, frame)
                if out.at > SHARD_BYTES:
                    done.append(out.close())
                    out, roll = None, roll + 1
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["shard", "n_docs", "n_tokens"])

    rows = ranged.mapInArrow(frugal(stored), "shard long, n_docs long, n_tokens long").collect()  # three numbers a shard
    return spark.createDataFrame(sorted(map(tuple, rows)), "shard long, n_docs long, n_tokens long")


class Writer:
    """One shard in the making: frames go straight to a draft that ``close`` finishes and moves into place.

    A task that runs twice writes the same shard twice under two draft names;
    the last move wins and both files are equal.
    """

    def __init__(self, folder: str, shard: int, dictionary: int):
        self.shard, self.at, self.index, self.tokens = shard, HEADER.size, [], 0
        self.fs, self.path = filesystem(f"{folder}/shard-{shard:012d}.ids")
        self.draft = f"{self.path}.{os.getpid()}-{os.urandom(6).hex()}"
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(HEADER.pack(MAGIC, dictionary))

    def add(self, doc_id: int, n_tokens: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((doc_id, n_tokens, self.at, len(frame)))
        self.at += len(frame)
        self.tokens += n_tokens

    def close(self) -> tuple[int, int, int]:
        self.out.write(np.array(self.index, "<i8").tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.index), self.tokens, MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.shard, len(self.index), self.tokens


class Shard:
    """One shard file; ``ids(k)`` reads the k-th document without its neighbours."""

    def __init__(self, folder: str, shard: int):
        self.fs, path = filesystem(f"{folder}/shard-{shard:012d}.ids")
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        at, self.n_docs, self.n_tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        head, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        with self.fs.open_input_stream(filesystem(f"{folder}/dictionary.zdict")[1]) as f:
            dictionary = f.read()
        if (head, magic) != (MAGIC, MAGIC) or digest != xxhash.xxh3_64_intdigest(dictionary):
            raise ValueError(f"shard {shard} of {folder}: wrong magic or another dictionary")
        self.index = np.frombuffer(self.file.read_at(self.n_docs * 32, at), "<i8").reshape(-1, 4)
        self.unpress = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))

    def raw(self, k: int) -> bytes:
        _, _, at, size = self.index[k]
        return self.unpress.decompress(self.file.read_at(int(size), int(at)))

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), "<u4")

    def find(self, doc_id: int) -> int:
        """The first position of ``doc_id``; -1 if this shard has none."""
        found = np.flatnonzero(self.index[:, 0] == doc_id)
        return int(found[0]) if len(found) else -1

    def close(self) -> None:
        self.file.close()


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, shard, position in the shard."""
    shards = [tuple(r) for r in manifest.orderBy("shard").collect()]  # three numbers a shard
    starts, total = [], 0
    for shard, _, n in shards:
        starts.append((shard, total))
        total += n
    plan = spark.createDataFrame(starts, "shard long, start long").repartition(max(1, len(starts)))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = Shard(folder, shard)
                for begin in range(0, file.n_docs, 4096):
                    rows = []
                    for k in range(begin, min(begin + 4096, file.n_docs)):
                        raw = file.raw(k)
                        i, n = (int(x) for x in file.index[k, :2])
                        if len(raw) != 4 * n:
                            raise ValueError(f"shard {shard}, document {i}: {len(raw)} bytes for {n} ids")
                        rows.append((None if i == NULL_ID else i, start, n, zlib.crc32(raw), shard, k))
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "position"])
                file.close()

    return plan.mapInArrow(frugal(opened), "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, position long")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True, order: Column | None = None) -> DataFrame:
    """Write ``docs`` to a new folder of the shared directory and read every document back."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    return read_token_files(spark, folder, write_token_files(docs, tokenizer_path, folder, id_col, text_col, added_tokens, order))
