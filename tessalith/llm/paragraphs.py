"""Substring dedup: paragraphs by MinHash banding, exact verification, removal by components.

1. *Paragraphs.*  Repeated passages start and end anywhere, so paragraphs are
   cut by content: a word begins one if the hash of it and the next word is the
   least within ``REACH`` words.  Inside a passage that two texts share the
   cuts are the same, and a passage of over 50 words holds whole paragraphs.
   Paragraphs of fewer than five words are left out.
2. *Banding.*  A paragraph's set is its 5-word shingles.  ``bands()`` gives the
   least number of bands of ``ROWS`` MinHash values that reaches ``RECALL`` at
   the similarity ``PERCENT``; equal paragraphs always collide.  Band keys are
   counted as in the set join's sieve; a paragraph that shares no key is done.
3. *Verification.*  Equal paragraphs are one set.  Sets that share a band key
   are joined on it, and every colliding pair is verified by exact Jaccard
   inside its task; what leaves the task is a forest of the links.  A key that
   more than ``HOT`` different sets have would make too many pairs: such sets
   go through the exact index of the set join, which finds all their links.
4. *Removal.*  Components of the verified links are clusters.  The first
   occurrence (by document, then place) stays, the others are marked removed.
5. *Passages.*  Paragraphs of clusters that stand in two documents and follow
   each other are one passage, also over a gap of at most ``BRIDGE`` words if
   both sides stand as far apart in the other document (an edit inside).  At its
   ends a passage grows as far as both documents are alike there.  It counts
   if it is ``LEAST_WORDS`` long and either has no gap or ``PERCENT`` of its words
   are matched: lines that many documents have are not passages.

Defined results.  Null and empty texts have no paragraph.  Long texts are read
whole.  Rows with an equal id and text are one document; with another text they
are another.  A null id is kept and sorts last.  Empty table: no rows.  Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessalith.llm import set_join
from tessalith.llm.components import components
from tessalith.llm.kernel import U64, Runs, frugal, mixed, slices, windows, words
from tessalith.llm.storage import partitions_for, removed, written

REACH, WIDTH, LEAST_WORDS = 5, 5, 45
PERCENT, ROWS, RECALL = 75, 3, 0.95
#: Words of a gap inside a passage at most, words by which its sides may have moved, and words that a passage grows by at an end.
BRIDGE, MOVED, CONTEXT = 30, 3, 24
#: Band keys that a task counts before it sends them on.
CHUNK = 1_000_000
#: Different sets of one band key up to which all of them are compared.
HOT = 256
#: Sets, and pairs of sets with a common shingle, that are compared at once.
SETS_AT_ONCE, PAIRS_AT_ONCE = 20_000, 2_000_000
#: Marked paragraphs up to which they (16 bytes each) are sent to all workers to pick the texts; beyond, the texts are shuffled.
BROADCAST_ROWS = 100_000
#: Digests that a task remembers to have sent the set for.
SEEN = 1_000_000
_ODD = [int(x) | 1 for x in np.random.default_rng(77).integers(1, 2**63, 64)]


def bands(rows: int = ROWS, similarity: float = PERCENT / 100, recall: float = RECALL) -> int:
    """The least number of bands of ``rows`` values with which two sets of this similarity collide with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Paragraphs:
    """The paragraphs of some texts: first word and word past the last (of all texts together), row, and shingles."""

    def __init__(self, runs: Runs):
        h = runs.hashes(lower=True)
        n = len(h)
        value = np.full(n, np.iinfo(np.uint64).max)
        if n:
            value[:-1] = mixed(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:])
            value[runs.first[1:][np.diff(runs.first) > 0] - 1] = np.iinfo(np.uint64).max  # the last word of a text has no next one
        begin = np.ones(n, bool)
        begin[value == np.iinfo(np.uint64).max] = False
        for d in range(1, min(REACH, n - 1) + 1):
            same = runs.row[d:] == runs.row[:-d]
            begin[d:] &= ~same | (value[d:] < value[:-d])  # of equal ones the first
            begin[:-d] &= ~same | (value[:-d] <= value[d:])
        begin[runs.first[:-1][np.diff(runs.first) > 0]] = True
        self.begin = np.flatnonzero(begin)
        row = runs.row[self.begin]
        self.end = np.minimum(np.append(self.begin[1:], n), runs.first[row + 1])
        self.number = np.arange(len(self.begin)) - np.searchsorted(row, row)
        shingle, start, _ = windows(h, runs.first, WIDTH)
        own = np.searchsorted(self.begin, start, "right") - 1
        inside = start + WIDTH <= self.end[own] if len(start) else np.zeros(0, bool)
        self.shingle, own = shingle[inside], own[inside]
        full = self.end - self.begin >= WIDTH
        self.begin, self.end, self.row, self.number = self.begin[full], self.end[full], row[full], self.number[full]
        self.first = np.searchsorted((np.cumsum(full) - 1)[own], np.arange(len(self.begin) + 1))

    def __len__(self) -> int:
        return len(self.begin)

    def keys(self) -> np.ndarray:
        """Band keys (paragraphs x bands)."""
        out = np.zeros((len(self), bands()), U64)
        for b in range(bands() if len(self) else 0):
            key = np.full(len(self), U64(b))
            for r in range(ROWS):
                least = np.minimum.reduceat(self.shingle * U64(_ODD[b * ROWS + r]), self.first[:-1])
                key = mixed(key * U64(0x9FB21C651E98DF25) + least)
            out[:, b] = key
        return out

    def set_of(self, k: int) -> np.ndarray:
        return np.unique(self.shingle[self.first[k] : self.first[k + 1]])


def suspects(docs: DataFrame) -> DataFrame:
    """(i, h, number) of the paragraphs that share a band key, of rows (i, h, t)."""
    buckets = partitions_for(docs, set_join.BUCKET_BYTES)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, keys, told, size = TaskContext.get().partitionId() << 24, [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(keys)
            out, local = set_join.messages(chunk, flat.ravel(), np.repeat(np.arange(len(flat)), bands()), len(flat), buckets)
            yield out
            yield set_join.about_itself(chunk, buckets, np.concatenate([*np.concatenate(told, axis=1), local]).astype("<i8").tobytes())

        for batch in batches:
            for part, text in slices(batch, "t"):
                found = Paragraphs(words(text))
                if len(found):
                    keys.append(found.keys())
                    known = part.column("i").is_valid().to_numpy(zero_copy_only=False)[found.row]
                    told.append(np.stack([part.column("i").fill_null(0).to_numpy()[found.row], known, part.column("h").to_numpy()[found.row], found.number]))
                    size += keys[-1].size
                if size >= CHUNK:
                    yield from rows()
                    chunk, keys, told, size = chunk + 1, [], [], 0
        if keys:
            yield from rows()

    def decided(rows: pa.Table) -> pa.Table:
        about = next(a for a in rows.column("about").to_pylist() if a is not None)
        ids, known, texts, numbers, total = np.frombuffer(about, "<i8").reshape(5, -1).copy()
        for x in rows.column("shared").to_pylist():
            if x:
                who, times = np.frombuffer(x, "<u4").reshape(-1, 2).T
                total[who] += times
        on = total > 0
        return pa.table({"i": pa.array(ids[on], mask=known[on] == 0), "h": texts[on], "number": numbers[on]})

    found = set_join.shared_in(docs.mapInArrow(frugal(sent), set_join.MESSAGE), buckets)
    return found.groupBy("chunk").applyInArrow(decided, "i long, h long, number long").distinct()


PICKED = "i long, h long, number long, begin long, n_words long, sig long, before binary, after binary, set binary, keys array<long>"
_PICKED = (*[pa.int64()] * 6, *[pa.binary()] * 3, pa.list_(pa.int64()))


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted paragraphs with their set's digest and the words around them (two bytes each, the nearest first); set and band keys once for each digest of a task."""
    seen: set[int] = set()
    for batch in batches:
        for part, text in slices(batch, "t"):
            runs = words(text)
            found = Paragraphs(runs)
            brief = (runs.hashes(lower=True) >> U64(48)).astype("<u2")
            ids, texts, wanted = part.column("i").to_pylist(), part.column("h").to_pylist(), [set(w) for w in part.column("numbers").to_pylist()]
            mine = [k for k, (row, number) in enumerate(zip(found.row.tolist(), found.number.tolist(), strict=True)) if number in wanted[row]]
            keys = found.keys().view(np.int64) if mine else None
            rows = []
            for k in mine:
                row, a, b = found.row[k], int(found.begin[k]), int(found.end[k])
                own = found.set_of(k)
                sig = int.from_bytes(set_join.set_digest(own)[:8], "little", signed=True)
                before = brief[max(int(runs.first[row]), a - CONTEXT) : a][::-1].tobytes()
                after = brief[b : min(int(runs.first[row + 1]), b + CONTEXT)].tobytes()
                new = sig not in seen
                rows.append((ids[row], texts[row], int(found.number[k]), a - int(runs.first[row]), b - a, sig, before, after, own.astype("<u8").tobytes() if new else None, keys[k].tolist() if new else None))
                seen.add(sig)
            if len(seen) > SEEN:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PICKED, strict=True)], names=[f.split()[0] for f in PICKED.split(", ")])


def verified_links(group: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest place that it reaches by links to sets of its group (groups are runs)."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate([np.zeros(0, U64), *sets]), np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((owner, flat, group[owner]))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (group[owner[1:]] != group[owner[:-1]])
    # Each entry is paired with the later ones of its run, a bounded number of pairs at once; the counts add up by group.
    run_end = np.append(np.flatnonzero(new), len(flat))[np.cumsum(new)]
    later = run_end - np.arange(len(flat)) - 1
    label = np.arange(len(sets))
    edges = np.append(np.flatnonzero(np.diff(group[owner], prepend=-1)), len(flat)) if len(flat) else np.zeros(1, np.int64)
    weight = np.add.reduceat(later, edges[:-1]) if len(flat) else np.zeros(0, np.int64)
    cut = np.searchsorted(np.cumsum(weight), np.arange(PAIRS_AT_ONCE, weight.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE)) if len(weight) else []
    for a, b in zip([0, *(c + 1 for c in cut)], [*(min(c + 1, len(weight)) for c in cut), len(weight)], strict=True):
        if a >= b:
            continue
        lo, hi = edges[a], edges[b]
        m = later[lo:hi]
        x = np.repeat(np.arange(lo, hi), m)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        code, both = np.unique(owner[x] * len(sets) + owner[y], return_counts=True)
        x, y = code // len(sets), code % len(sets)
        linked = 100 * both >= percent * (n[x] + n[y] - both)
        x, y = x[linked], y[linked]
        while len(x):
            a, b = label[x], label[y]
            least = np.minimum(a, b)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while (label != label[label]).any():
                label = label[label]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
    return label


def _colliding(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the sets that have a band key in common, from rows (key, rep, set) in order of their keys."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, rep = rows.column("key").to_numpy(), rows.column("rep").to_numpy()
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        label = verified_links(group, [np.frombuffer(x, "<u8") for x in rows.column("set").to_pylist()], percent)
        a, b = rep, rep[label]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= SETS_AT_ONCE:
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield links(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
    if held:
        yield links(pa.Table.from_batches(held))


def link_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(v, c): for every set of (rep, set, keys) that links with a colliding one the smallest rep of its component."""
    entries = sets.select("rep", F.explode("keys").alias("key"))
    members = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    several = written(entries.join(members, "key"), "collisions")
    own = sets.select("rep", "set")
    some = several.filter(F.col("members") <= HOT).select("key", "rep").join(own, "rep")
    some = some.repartition(partitions_for(sets, set_join.BUCKET_BYTES), "key").sortWithinPartitions("key")
    edges = written(some.mapInArrow(frugal(lambda b: _colliding(b, percent)), "a long, b long").distinct(), "links")
    hot = written(several.filter(F.col("members") > HOT).select("rep").distinct().join(own, "rep"), "hot")
    links = edges if hot.isEmpty() else edges.unionByName(set_join.link_components(hot, percent).select(F.col("v").alias("a"), F.col("c").alias("b")))
    out = components(links)
    removed(sets.sparkSession, several, edges, hot)
    return out


def same_words(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """How far two contexts are alike: the most words of which at least ``percent`` stand at the same places in both."""
    n = (F.least(F.octet_length(a), F.octet_length(b)) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(1), F.lit(CONTEXT)), lambda k: (k <= n) & (F.substring(a, 2 * k - 1, F.lit(2)) == F.substring(b, 2 * k - 1, F.lit(2))))
    good = F.transform(places, lambda p, k: F.when(100 * (k + 1) >= percent * p, p).otherwise(0))
    return F.coalesce(F.array_max(good), F.lit(0))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, paragraph, begin_word, n_words, first_doc_id, first_paragraph, removed, passage_words of each paragraph in a repeated passage."""
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    own = docs.select(docs[id_col].cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("t"))
    marked = written(suspects(own), "suspects")
    wanted = marked.groupBy("i", "h").agg(F.collect_list("number").alias("numbers"))  # one text's paragraphs at most
    wanted = (F.broadcast(wanted) if marked.count() <= BROADCAST_ROWS else wanted).alias("w")
    chosen = own.alias("o").join(wanted, F.col("o.i").eqNullSafe(F.col("w.i")) & (F.col("o.h") == F.col("w.h"))).select("o.*", "w.numbers")
    picked = written(chosen.mapInArrow(frugal(_picked), PICKED), "paragraphs")
    sets = written(picked.filter("set is not null").select(F.col("sig").alias("rep"), "set", "keys").dropDuplicates(["rep"]), "sets")
    parts = link_components(sets, percent)
    document = F.struct(F.col("i").isNull().alias("none"), "i", "h")
    clusters = picked.join(set_join.small(parts), picked.sig == parts.v, "left").withColumn("cluster", F.coalesce("c", "sig"))
    clusters = clusters.select(document.alias("d"), "number", "begin", "n_words", "cluster", "before", "after")
    # Rows with an equal id and text repeat their paragraphs.
    repeated = not own.groupBy("i", "h").count().filter("count > 1").isEmpty()
    clusters = written(clusters.dropDuplicates(["d", "number"]) if repeated else clusters, "clusters")
    removed(spark, marked, sets, picked)
    place = F.struct("d", "number", "begin", "n_words", "before", "after")
    across = clusters.groupBy("cluster").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first.d < last.d")
    other = F.when(F.col("d") == F.col("first.d"), F.col("last")).otherwise(F.col("first"))
    rows = clusters.join(across, "cluster").withColumn("other", other).select("d", "number", "begin", "n_words", "before", "after", F.col("first.d").alias("first"), F.col("first.number").alias("first_number"), "other")
    # Paragraphs that follow each other, or leave the same gap in the other document, form a passage.
    end = F.col("begin") + F.col("n_words")
    order = Window.partitionBy("d").orderBy("begin", "number")
    gap = F.col("begin") - F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    there = F.col("other.begin") - F.col("begin")
    along = (F.lag("other.d").over(order) == F.col("other.d")) & (F.abs(there - F.lag(there).over(order)) <= MOVED) & (gap <= BRIDGE)
    rows = rows.withColumns({"opens": F.when(gap < WIDTH, 0).otherwise(1), "new": F.when((gap < WIDTH) | along, 0).otherwise(1)})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"piece": F.sum("opens").over(so_far), "passage": F.sum("new").over(so_far), "closes": F.coalesce(F.lead("opens").over(order), F.lit(1))})
    grown = lambda edge, side: F.when(F.col(edge) == 1, same_words(F.col(side), F.col(f"other.{side}"))).otherwise(0)
    rows = rows.withColumns({"ahead": grown("opens", "before"), "behind": grown("closes", "after")})
    matched = F.col("n_words") + F.col("ahead") + F.col("behind")
    length = lambda w: F.max(end + F.col("behind")).over(w) - F.min(F.col("begin") - F.col("ahead")).over(w)
    piece, passage = Window.partitionBy("d", "piece"), Window.partitionBy("d", "passage")
    rows = rows.withColumns({"run": length(piece), "whole": length(passage), "matched": F.sum(matched).over(passage)})
    whole = (F.col("whole") >= least_words) & (100 * F.col("matched") >= percent * F.col("whole"))
    rows = rows.filter(whole | (F.col("run") >= least_words))
    is_first = (F.col("d") == F.col("first")) & (F.col("number") == F.col("first_number"))
    return rows.select(F.col("d.i").alias(id_col), F.col("number").alias("paragraph"), F.col("begin").alias("begin_word"), "n_words", F.col("first.i").alias("first_doc_id"), F.col("first_number").alias("first_paragraph"), (~is_first).alias("removed"), F.when(whole, F.col("whole")).otherwise(F.col("run")).alias("passage_words"))
