"""N-gram Jaccard join by set-relation skipping, and the components of its links.

Every document is the set of its 5-word shingles; two link when their Jaccard
similarity is at least ``PERCENT`` / 100.  The join is exact (up to collisions
of 64-bit hashes) and never emits the pairs of a group.

1. *Sieve.*  A linked document shares at least ``PERCENT`` % of its shingles.
   Shingles are counted by 32 bits inside hash buckets; a task sends each
   distinct shingle once and owns those that occur twice in its own texts, so a
   shingle that a third of all documents has costs one entry a task.  Documents
   below the share are done: they link with nothing.
2. *Copies.*  Equal sets are one, told by their digest.
3. *Index.*  Shingles are ordered by how many representatives have them; the
   first ``n - ceil(t n) + 1`` are a set's prefix, and two linked sets share a
   prefix shingle.  A shingle's list is led by its most central set (mean
   log-count of its shingles); a set's home is the best of its leaders, and
   sets with one home form blocks of bounded size.
4. *Answers inside blocks.*  A block takes the home's set as pivot p.  With
   the difference lists p - x and x - p the answers of all other members follow
   from the pivot's: |x & y| = |p & x| + |p & y| - |p| + |(p-x) & (p-y)| +
   |(x-p) & (y-p)|, where only shingles in two difference lists are touched, and
   only for pairs whose relations to the pivot leave the overlap possible.
5. *Skipping between blocks.*  A list is kept as blocks, each with the sizes of
   its sets and what follows the shingle's position in them.  Only sets that are
   not in the component of a list's leader visit the list's other blocks, and
   of those only the ones whose size and position still allow the overlap.

Sets that already stand in one component are not compared again, so a group of
near copies costs blocks and visits, not pairs.

Defined results.  Null and empty texts and texts without words have no
shingles and stand alone.  Texts with fewer words than ``WIDTH`` are one
shingle.  Long texts are read whole.  Rows with an equal id are one document:
each keeps its row, and all are in one component whatever their texts.  A row
with a null id links like any other; it names no component, so its component
is null where no row with an id is in it.  Empty table: no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessalith.llm.components import components
from tessalith.llm.kernel import U64, frugal, mixed, set_digest, shingle_sets, slices, words
from tessalith.llm.storage import partitions_for, removed, written

WIDTH, PERCENT = 5, 75
#: Shingles that a task counts before it sends them on.
CHUNK = 1_000_000
#: Input bytes for each bucket of the counting steps.
BUCKET_BYTES = 12 << 20
#: Sets and shingles in a block, about; columns of a difference matrix at once.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 256, 1_000_000, 8192
#: Representatives up to which their ids (8 bytes) are sent to all workers to pick their texts; beyond, the texts are shuffled.
BROADCAST_ROWS = 500_000


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap with any linked set: ceil(t n)."""
    return -(-n * percent // 100)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def home_bucket(chunk: int, buckets: int) -> int:
    """Where a chunk's words about itself go: spread by a hash, since chunk numbers are multiples."""
    return int(mixed(np.array([chunk], U64))[0] % U64(buckets))


def spans(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for part, text in slices(batch, "t"):
            yield list(zip(part.column("i").to_pylist(), part.column("h").to_pylist(), strict=True)), shingle_sets(words(text), width)


# --- 1. the sieve -----------------------------------------------------------


MESSAGE = "chunk long, bucket int, keys binary, owners binary, several binary, about binary"


def cut_up(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values[bounds[k] : bounds[k + 1]]`` for each k."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def messages(chunk: int, keys: np.ndarray, owner: np.ndarray, items: int, buckets: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """What a chunk tells the buckets, and how many keys of each item another item of the chunk has too.

    A key that one item has goes with its owner; a key of several items goes
    once and without owners, who know by themselves that they share it.  Only
    buckets that have a key of the chunk get a message: there are at most as
    many messages as keys, however many buckets there are.
    """
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    times = np.diff(np.append(start, len(keys)))
    local = np.bincount(owner[np.repeat(times > 1, times)], minlength=items).astype("<i8")
    single, several = start[times == 1], start[times > 1]
    bucket = bucket_of(keys[start], buckets)
    told = np.unique(bucket)
    of_single, of_several = (np.append(np.searchsorted(bucket_of(keys[x], buckets), told), len(x)) for x in (single, several))
    none = pa.nulls(len(told), pa.binary())
    columns = [pa.array(np.full(len(told), chunk, np.int64)), pa.array(told.astype(np.int32)), cut_up(keys[single].astype("<u4"), of_single), cut_up(owner[single].astype("<u4"), of_single), cut_up(keys[several].astype("<u4"), of_several), none]
    return pa.RecordBatch.from_arrays(columns, names=MESSAGE_NAMES), local


MESSAGE_NAMES = [f.split()[0] for f in MESSAGE.split(", ")]


def about_itself(chunk: int, buckets: int, about: bytes) -> pa.RecordBatch:
    """What a chunk keeps for when its answers are there."""
    columns = [pa.array([chunk], pa.int64()), pa.array([home_bucket(chunk, buckets)], pa.int32()), *[pa.nulls(1, pa.binary())] * 3, pa.array([about], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=MESSAGE_NAMES)


def _chunk_rows(chunk: int, ids: list, sets: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    n = np.array([len(s) for s in sets], np.int64)
    rows, local = messages(chunk, np.concatenate([np.zeros(0, U64), *sets]), np.repeat(np.arange(len(sets)), n), len(sets), buckets)
    yield rows
    about = pa.array([(i, h, int(k), int(m), set_digest(s)) for (i, h), k, m, s in zip(ids, n, local, sets, strict=True)], _ABOUT)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("about", _ABOUT)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([about], names=["about"]))
    yield about_itself(chunk, buckets, sink.getvalue().to_pybytes())


_ABOUT = pa.struct([("i", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("local", pa.int64()), ("sig", pa.binary())])


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk", "shared", "about"]
    chunks, keys, owners, several = [], [], [], []
    for batch in batches:
        own = batch.filter(batch.column("about").is_valid())
        if len(own):
            yield pa.RecordBatch.from_arrays([own.column("chunk"), pa.nulls(len(own), pa.binary()), own.column("about")], names=names)
        rest = batch.filter(batch.column("about").is_null())
        chunks.append(np.repeat(rest.column("chunk").to_numpy(), pc.binary_length(rest.column("keys")).to_numpy() // 4))
        for to, c in ((keys, "keys"), (owners, "owners"), (several, "several")):
            to.append(np.frombuffer(b"".join(rest.column(c).to_pylist()), "<u4"))
    if not chunks:
        return
    chunk, flat, owner, known = (np.concatenate(x) for x in (chunks, keys, owners, several))
    del chunks, keys, owners, several
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    same = np.zeros(len(flat), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    known = np.unique(known)
    if len(known):
        at = np.minimum(np.searchsorted(known, ordered), len(known) - 1)
        same |= known[at] == ordered
    mine = order[same]
    # For each chunk that shares a key: its items and how many of their keys are shared.
    ordered = np.lexsort((owner[mine], chunk[mine]))
    chunk, owner = chunk[mine][ordered], owner[mine][ordered]
    new = np.ones(len(chunk), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    pairs = np.stack([owner[at], np.diff(np.append(at, len(chunk)))], axis=1).astype("<u4")
    bounds = np.append(np.flatnonzero(np.diff(chunk[at], prepend=-1)), len(at))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(chunk[at][bounds[:-1]], pa.int64()), cut_up(pairs.ravel(), 2 * bounds), pa.nulls(len(bounds) - 1, pa.binary())], names=names)


def shared_in(found: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket the items that share keys with other chunks and how many, and what the chunk said about itself."""
    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(frugal(_count_bucket), "chunk long, shared binary, about binary")


def sieve(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(i, h, n, sig, open): of every row of (i, h, t) id and hash of the text, set size, digest of its set, and whether enough of it is shared to link."""
    buckets = partitions_for(docs, BUCKET_BYTES)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, sets, size = TaskContext.get().partitionId() << 24, [], [], 0
        for own, found in _split(batches, width):
            ids += own
            sets += found
            size += sum(map(len, found))
            if size >= CHUNK:
                yield from _chunk_rows(chunk, ids, sets, buckets)
                chunk, ids, sets, size = chunk + 1, [], [], 0
        if ids:
            yield from _chunk_rows(chunk, ids, sets, buckets)

    def decided(rows: pa.Table) -> pa.Table:
        shared = rows.column("shared").to_pylist()
        about = next(a for a in rows.column("about").to_pylist() if a is not None)
        with pa.ipc.open_stream(about) as stream:
            about = stream.read_all().column(0).combine_chunks()
        i, h, n, total, sig = (about.field(k) for k in range(5))
        total = total.to_numpy().copy()
        for x in shared:
            if x:
                who, times = np.frombuffer(x, "<u4").reshape(-1, 2).T
                total[who] += times
        n_ = n.to_numpy()
        return pa.table({"i": i, "h": h, "n": n, "sig": sig, "open": pa.array((n_ > 0) & (100 * total >= percent * n_))})

    return shared_in(docs.mapInArrow(frugal(sent), MESSAGE), buckets).groupBy("chunk").applyInArrow(decided, "i long, h long, n long, sig binary, open boolean")


# --- 3. the index -----------------------------------------------------------


def _set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(rep, set) of texts that still have the digest that they were picked for."""
    for batch in batches:
        for part, text in slices(batch, "t"):
            rows = [(rep, s.astype("<u8").tobytes()) for rep, sig, s in zip(part.column("rep").to_pylist(), part.column("sig").to_pylist(), shingle_sets(words(text), width), strict=True) if set_digest(s) == sig]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["rep", "set"])


def with_counts(sets: DataFrame) -> DataFrame:
    """(rep, set, df): for each shingle of each set how many sets have it, by the same two exchanges as the sieve.

    A set rides along through any bucket, told by its own number, and meets the
    answers of its chunk behind the second exchange.
    """
    buckets = partitions_for(sets, BUCKET_BYTES)
    names = ["chunk", "bucket", "keys", "times", "rep", "set"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.slice(begin, 2000)
                keys, times = np.unique(np.frombuffer(b"".join(part.column("set").to_pylist()), "<u8"), return_counts=True)
                bucket = bucket_of(keys, buckets)
                told = np.unique(bucket)
                bounds = np.append(np.searchsorted(bucket, told), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(told), chunk, np.int64)), pa.array(told.astype(np.int32)), cut_up(keys, bounds), cut_up(times.astype("<u4"), bounds), pa.nulls(len(told), pa.int64()), pa.nulls(len(told), pa.binary())], names=names)
                spread = (mixed(part.column("rep").to_numpy().view(U64)) % U64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, np.int64)), pa.array(spread), *[pa.nulls(len(part), pa.binary())] * 2, part.column("rep"), part.column("set")], names=names)
                chunk += 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "keys", "df", "rep", "set"]
        chunks, keys, times = [], [], []
        for batch in batches:
            own = batch.filter(batch.column("set").is_valid())
            if len(own):
                yield pa.RecordBatch.from_arrays([own.column("chunk"), *[pa.nulls(len(own), pa.binary())] * 2, own.column("rep"), own.column("set")], names=names)
            rest = batch.filter(batch.column("set").is_null())
            chunks.append(np.repeat(rest.column("chunk").to_numpy(), pc.binary_length(rest.column("keys")).to_numpy() // 8))
            keys.append(np.frombuffer(b"".join(rest.column("keys").to_pylist()), "<u8"))
            times.append(np.frombuffer(b"".join(rest.column("times").to_pylist()), "<u4"))
        if not chunks:
            return
        chunk, flat = np.concatenate(chunks), np.concatenate(keys)
        distinct, back = np.unique(flat, return_inverse=True)
        df = np.bincount(back, np.concatenate(times), len(distinct)).astype(np.int64)[back]
        many = np.flatnonzero(df > 1)  # a shingle without an answer is in one set only
        many = many[np.argsort(chunk[many], kind="stable")]
        bounds = np.append(np.flatnonzero(np.diff(chunk[many], prepend=-1)), len(many))
        if len(many):
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays([pa.array(chunk[many][bounds[:-1]], pa.int64()), cut_up(flat[many], bounds), cut_up(df[many].astype("<u4"), bounds), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

    def joined(rows: pa.Table) -> pa.Table:
        answers = [(np.frombuffer(k, "<u8"), np.frombuffer(d, "<u4")) for k, d in zip(rows.column("keys").to_pylist(), rows.column("df").to_pylist(), strict=True) if k is not None]
        keys = np.concatenate([np.zeros(0, U64), *(k for k, _ in answers)])
        df = np.concatenate([np.zeros(0, np.uint32), *(d for _, d in answers)])
        order = np.argsort(keys)
        keys, df = keys[order], df[order]
        reps, sets, out = [], [], []
        for rep, own in zip(rows.column("rep").to_pylist(), rows.column("set").to_pylist(), strict=True):
            if own is None:
                continue
            s = np.frombuffer(own, "<u8")
            found = np.ones(len(s), "<u4")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                found = np.where(keys[at] == s, df[at], 1).astype("<u4")
            reps.append(rep)
            sets.append(own)
            out.append(found.tobytes())
        return pa.table({"rep": pa.array(reps, pa.int64()), "set": pa.array(sets, pa.binary()), "df": pa.array(out, pa.binary())})

    messages = sets.select("rep", "set").mapInArrow(frugal(sent), "chunk long, bucket int, keys binary, times binary, rep long, set binary")
    answers = messages.repartitionById(buckets, F.col("bucket")).mapInArrow(frugal(counted), "chunk long, keys binary, df binary, rep long, set binary")
    return answers.groupBy("chunk").applyInArrow(joined, "rep long, set binary, df binary")


def prefixes(counted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rep, n, central, entries[(token, place)]): the shared shingles in each set's prefix; sets that share too little are gone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rep, own, df in zip(batch.column("rep").to_pylist(), batch.column("set").to_pylist(), batch.column("df").to_pylist(), strict=True):
                s, d = np.frombuffer(own, "<u8"), np.frombuffer(df, "<u4")
                least = int(needed(np.int64(len(s)), percent))
                if (d > 1).sum() < least:
                    continue
                order = np.lexsort((s, d))[: len(s) - least + 1]
                place = np.flatnonzero(d[order] > 1)
                rows.append((rep, len(s), float(np.log2(d).mean()), s[order][place].view(np.int64).tolist(), place.tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["rep", "n", "central", "token", "place"])

    found = counted.mapInArrow(frugal(cut), "rep long, n long, central double, token array<long>, place array<long>")
    return found.select("rep", "n", "central", F.arrays_zip("token", "place").alias("entries"))


# --- 4. and 5. answers ------------------------------------------------------


class Answers:
    """Overlaps of sets with each other, all derived from their differences to one pivot."""

    def __init__(self, pivot: np.ndarray, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, U64), *sets])
        row = np.repeat(np.arange(len(sets)), n)
        if len(pivot):
            at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
            common = pivot[at] == flat
        else:
            at, common = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
        self.n, self.pivot_size = n, len(pivot)
        self.kind = np.float32 if max(n.max(initial=0), len(pivot)) < 1 << 23 else np.float64  # sums of whole numbers stay exact
        self.with_pivot = np.bincount(row[common], minlength=len(sets)).astype(np.int64)
        # Additions: shingles of a set that the pivot lacks, if two sets have them.
        _, back, times = np.unique(flat[~common], return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        extra = times[back] > 1
        self.additions = (row[~common][extra], column[back[extra]], int((times > 1).sum()))
        # Omissions: shingles of the pivot that a set lacks, if two sets lack them; all lack or have them in common else.
        has = np.bincount(at[common], minlength=len(pivot)) if len(pivot) else np.zeros(0, np.int64)
        self.row, self.at = row[common], at[common]
        self.varying = np.flatnonzero((has < len(sets) - 1))
        self.never = int((has == 0).sum())

    def overlaps(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """|x & y| for x in ``one`` and y in ``other`` (places of sets)."""
        total = (self.with_pivot[one][:, None] + self.with_pivot[other][None, :] - self.pivot_size).astype(self.kind)
        total += self._both(one, other, *self.additions, absent=False)
        column = np.full(self.pivot_size, -1, np.int64)
        column[self.varying] = np.arange(len(self.varying))
        inside = column[self.at] >= 0
        total += self._both(one, other, self.row[inside], column[self.at[inside]], len(self.varying), absent=True)
        return np.rint(total).astype(np.int64)

    def _both(self, one: np.ndarray, other: np.ndarray, row: np.ndarray, column: np.ndarray, width: int, absent: bool) -> np.ndarray:
        out = np.zeros((len(one), len(other)), self.kind)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for begin in range(0, width, COLUMNS):
            a, b = np.searchsorted(column, [begin, begin + COLUMNS])
            m = np.full((len(self.n), min(COLUMNS, width - begin)), absent, self.kind)
            m[row[a:b], column[a:b] - begin] = not absent
            out += m[one] @ m[other].T
        return out

    def hopeful(self, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs may link by their relations to the pivot alone.

        What x and y share lies in the pivot or beside it: at most
        min(|x & p|, |y & p|) + min(|x - p|, |y - p|) shingles.
        """
        inside, beside = self.with_pivot, self.n - self.with_pivot
        most = np.minimum(inside[one][:, None], inside[other]) + np.minimum(beside[one][:, None], beside[other])
        return 100 * most >= percent * (self.n[one][:, None] + self.n[other] - most)

    def links(self, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs link.  Only the rows and columns of pairs that may link are worked out."""
        out = self.hopeful(one, other, percent)
        if one is other:
            np.fill_diagonal(out, False)
        a, b = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
        if len(a):
            both = self.overlaps(one[a], other[b])
            out[np.ix_(a, b)] &= 100 * both >= percent * (self.n[one[a]][:, None] + self.n[other[b]] - both)
        return out


def _grouped(linked: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches by links."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_edges(rows: pa.Table, percent: int) -> pa.Table:
    """Links of a block's members with each other (as a forest) and of its visitors with members."""
    reps = rows.column("rep").to_numpy()
    guest = rows.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((reps, guest))
    reps, guest = reps[order], guest[order]
    blobs = rows.column("set").to_pylist()
    sets = [np.frombuffer(blobs[k], "<u8") for k in order]
    central = rows.column("central").to_numpy()[order]
    part = rows.column("part").to_numpy()[order]
    answers = Answers(sets[int(central.argmax())], sets)
    members, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
    a, b = [], []
    if len(members) and part[members[0]] < 0:  # the first round: members among themselves
        label = _grouped(answers.links(members, members, percent))
        a.append(reps[members])
        b.append(reps[members][label])
    if len(guests) and len(members):
        linked = answers.links(guests, members, percent)
        # A guest needs one link into each component that the members already form.
        for g, row in zip(guests, linked, strict=True):
            near = members[row]
            if len(near):
                _, one = np.unique(part[near] if part[near[0]] >= 0 else reps[near], return_index=True)
                a.append(np.full(len(one), reps[g]))
                b.append(reps[near[one]])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(v, c): for every set of (rep, set) that links with another the smallest rep of its component."""
    counted = written(with_counts(sets), "counted")
    found = written(prefixes(counted, percent), "prefixes")
    lists = found.select("rep", "n", "central", F.explode("entries").alias("e")).select("rep", "n", "central", "e.token", "e.place")
    out = components_of_lists(lists, counted, percent)
    removed(sets.sparkSession, counted, found)
    return out


def components_of_lists(lists: DataFrame, counted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same from any index: (token, rep, n, central, place) has a common token for every two sets that may link."""
    spark = lists.sparkSession
    leaders = lists.groupBy("token").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("leader"), F.max("central").alias("lead"), F.count("*").alias("members")).filter("members > 1").drop("members")
    lists = written(lists.join(leaders, "token"), "lists")
    homes = lists.groupBy("rep").agg(F.max("n").alias("n"), F.max("central").alias("central"), F.max_by("leader", F.struct("lead", -F.col("leader"))).alias("home"))
    sizes = homes.groupBy("home").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_SHINGLES))
    placed = homes.join(sizes.select("home", parts.alias("parts")), "home")
    placed = written(placed.select("rep", "n", "central", "home", F.xxhash64("home", F.pmod(F.xxhash64("rep"), "parts")).alias("block")), "blocks")
    own = counted.select("rep", "set")
    guests = placed.select("block", F.col("home").alias("rep")).distinct().join(placed.select("rep", "central", F.col("block").alias("at")), "rep").filter("at != block").select("rep", "central", "block", F.lit(True).alias("guest"))
    rows = placed.select("rep", "central", "block", F.lit(False).alias("guest")).unionByName(guests).withColumn("part", F.lit(-1).cast("long"))
    inner = rows.join(own, "rep").groupBy("block").applyInArrow(lambda t: _block_edges(t, percent), "a long, b long")
    inner = written(inner, "inner")
    first = components(inner)
    known = placed.join(first.withColumnRenamed("v", "rep"), "rep", "left").withColumn("part", F.coalesce("c", "rep")).drop("c")
    known = written(known, "known")
    # Lists as blocks: which blocks a list has, and whether any of their members may still be linked from outside.
    entries = lists.join(known.select("rep", "part", "block"), "rep")
    entries = entries.join(known.select(F.col("rep").alias("leader"), F.col("part").alias("lead_part")), "leader").select("token", "rep", "n", "place", "part", "block", "lead_part")
    blocks = entries.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("rest"), F.min("part").alias("part_low"), F.max("part").alias("part_high"))
    strays = entries.filter("part != lead_part").select("token", "rep", "n", "place", F.col("part").alias("own"), F.col("block").alias("home_block"))
    least = F.ceil((F.col("n") + F.greatest(F.col("low"), F.col("n") * percent / 100)) * percent / (100 + percent) - 1e-6)
    visits = strays.join(blocks, "token").filter((F.col("low") * percent <= F.col("n") * 100) & (F.col("high") * 100 >= F.col("n") * percent) & (F.least(F.col("n") - F.col("place"), "rest") >= least))
    # Members of its own block a set has met; a block all of whose entries are of its component has nothing for it.
    visits = visits.filter((F.col("block") != F.col("home_block")) & ~((F.col("part_low") == F.col("own")) & (F.col("part_high") == F.col("own")))).select("rep", "block").distinct()
    visits = written(visits, "visits")
    outer = None
    if not visits.isEmpty():
        # So many visitors of a block that they would fill a task come in several groups, each with the members.
        slots = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("slots"))
        members = known.join(slots, "block").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
        members = members.select("rep", "central", "block", "slot", F.lit(False).alias("guest"), "part")
        calls = visits.join(slots, "block").withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("slots"))).join(known.select("rep", "central", "part"), "rep")
        calls = calls.select("rep", "central", "block", "slot", F.lit(True).alias("guest"), "part")
        outer = members.unionByName(calls).join(own, "rep").groupBy("block", "slot").applyInArrow(lambda t: _block_edges(t, percent), "a long, b long")
        outer = written(outer, "outer")
    out = components(inner if outer is None else inner.unionByName(outer))
    removed(spark, lists, placed, known, visits, inner, first, *([outer] if outer is not None else []))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))
    rows = written(sieve(own, width, percent), "sieve")
    # A set is told by its digest, and its shingles come from the first row that has it; rows are told by id and text.
    first = F.min(F.struct(F.col("i").isNull().alias("none"), F.col("i"), F.col("h"))).alias("first")
    reps = rows.filter("open").groupBy("sig").agg(first).select(F.xxhash64("sig").alias("rep"), "sig", "first.i", "first.h")
    reps = written(reps, "reps")
    picked = own.alias("o").join(small(reps).alias("w"), F.col("o.i").eqNullSafe(F.col("w.i")) & (F.col("o.h") == F.col("w.h"))).select("o.t", "w.rep", "w.sig")
    sets = written(picked.mapInArrow(frugal(lambda b: _set_rows(b, width)), "rep long, set binary").dropDuplicates(["rep"]), "sets")
    parts = link_components(sets, percent)
    # Rows with one id are one document: its texts are in one component.  Empty texts link by their id only.
    told = rows.withColumn("v", F.when(F.col("n") > 0, F.xxhash64("sig")).otherwise(F.xxhash64(F.lit("empty"), F.col("i"))))
    ends = told.filter("i is not null").groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("z")).filter("a < z").select("i", "a")
    ends = written(ends, "several-texts")
    if not ends.isEmpty():
        through = told.join(ends, "i").select("a", F.col("v").alias("b")).filter("a != b")
        parts = components(parts.select(F.col("c").alias("a"), F.col("v").alias("b")).unionByName(through))
        ids = reps.select(F.col("rep").alias("v"), "i").unionByName(told.join(ends, "i").select("v", "i"))
    else:
        ids = reps.select(F.col("rep").alias("v"), "i")
    # The component's name is the smallest id in it.
    names = written(ids.join(parts, "v").groupBy("c").agg(F.min("i").alias("component_id")), "names")
    linked = parts.join(small(names), "c").select("v", "component_id")
    alone = reps.join(parts, reps.rep == parts.v, "left_anti").select(F.col("rep").alias("v"), F.col("i").alias("component_id"))
    named = written(linked.unionByName(alone), "named")
    out = told.join(small(named), "v", "left")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "i").alias("component_id"))


def small(table: DataFrame) -> DataFrame:
    """A written table, marked to be sent to all workers if it has at most ``BROADCAST_ROWS`` rows (of some numbers each)."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
