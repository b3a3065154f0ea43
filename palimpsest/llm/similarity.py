"""N-gram Jaccard join by PartEnum signatures (exact; one component id per document).

A document is the set of its distinct word shingles.  Sets fall into size bands such that
a partner of similarity p has a size in the same or the next band; a set takes part in the
*instance* of its own band and, as a guest, in that of the band below, so each pair has one
instance that counts (two guests are compared in the band of their own).

In an instance the 64-bit feature domain is cut twice: into G groups, and each group into
three partitions.  Two sets with J >= p differ in at most d elements, so all but d/2 groups
hold at most one differing element, and in such a group two of the three partitions agree.
The three subsets of two partitions of each group are enumerated, and the hash of a subset
is a signature.  G exceeds d/2 by a margin, so that empty partitions, and signatures that
very many sets share, need not be compared: a set has *room* for as many of them as it must
share groups with any partner, less one.  A set without room emits under a further seed.
Tiny sets enumerate their subsets with up to (1-p)|s| elements left out instead.

Candidates are compared exactly, unless their sizes or their parity sketches show that they
cannot be similar: a sketch has one bit for each of SKETCH_BITS cells of the domain, the
parity of the set's elements there.  A differing element flips one bit, so more than d
different bits mean more than d differing elements.

Members of a signature's bucket are compared with the bucket's smallest document only;
links found there join most buckets into one component.  What remains apart is then
compared across components (never within one), which keeps the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.shared import flag_ids, fresh_name, frugal, written
from palimpsest.llm.wordhash import mix64, text_slices, window_starts, windows, words

#: Sets of up to TINY elements enumerate subsets; larger ones (and the few sizes that can
#: be similar to a tiny one) use partitions from MIN_PARTED on.
MIN_PARTED = 10
SEEDS = 4
SKETCH_BITS = 1024
#: Buckets up to this size leave the task as lists, larger ones as rows.
HOT = 64
#: Members of listed buckets that a task holds before it writes the distinct ones.
HELD = 400_000
#: Smaller buckets of a document that a row of it names.
BEFORE = 8
#: A size row packs the set's size and its room.
ROOM_BITS = 20
ROOM_MAX = (1 << ROOM_BITS) - 1
#: Low bits of a tag: what a row of the signature exchange is.
OWN, GUEST, SET, COPY = range(4)
SIG_SCHEMA = "key long, doc long, tag long, words array<long>"
FOUND_SCHEMA = "kind int, a long, b long, c int, members array<long>"
PAIR, BUCKET, HOT_ROW, SAME, SIZE = range(5)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (hashes, bounds)."""
    w = words(texts, fold_case=True)
    counts = np.diff(w.bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes, docs = [], []
    for span in range(1, width + 1):
        h = windows(w.hashes, span)
        if not len(h):
            continue
        if span == width:
            at = np.flatnonzero(window_starts(w.bounds, span, len(w.hashes)))
        else:
            at = w.bounds[:-1][counts == span]
        hashes.append(mix64(h[at] + np.uint64(span)))
        docs.append(owner[at])
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[fresh], d[fresh]
    return h, np.searchsorted(d, np.arange(len(counts) + 1))


class Bands:
    """Size bands and the largest difference d of similar pairs, for J >= percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [MIN_PARTED, self.largest(MIN_PARTED) + 1]
        while edges[-1] < 1 << 40:
            edges.append(max(self.largest(edges[-1] - 1), edges[-1]) + 1)
        self.edges = np.array(edges, dtype=np.int64)
        top = self.edges[1:] - 1
        self.groups = np.array([self.first_level(self.differ(n, self.largest(n))) for n in top.tolist()], dtype=np.int64)

    def largest(self, n: int):
        """Largest partner of a set of n elements."""
        return n * 100 // self.percent

    def differ(self, n, m):
        """Most elements in which similar sets of n and m elements differ."""
        return (n + m) * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def first_level(d: int) -> int:
        """Groups of an instance: more than d/2 by a margin."""
        return d // 2 + 1 + max(2, -(-(d // 2) // 10))

    def tiny_limit(self) -> int:
        return int(self.largest(MIN_PARTED - 1))


_A, _B = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def _enumerated(h, bounds, which, groups, need, band, seed):
    """Signatures of the sets ``which``: (signature, index in which, room).

    room: groups that the set shares with any partner, less those whose agreed subset may be empty.
    """
    sizes = bounds[which + 1] - bounds[which]
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first - bounds[which], sizes)
    x, owner = h[at], np.repeat(np.arange(len(which)), sizes)
    if seed:
        x = mix64(x + np.uint64(seed) * _A)
        order = np.lexsort((x, owner))
        x = x[order]
    cells = 3 * groups
    base = np.cumsum(cells) - cells
    cell = base[owner] + (((x >> np.uint64(32)) * cells[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = cell[1:] != cell[:-1]
    runs = np.flatnonzero(new)
    sums = np.zeros(int(cells.sum()), np.uint64)
    sums[cell[runs]] = np.add.reduceat(mix64(x ^ _A), runs)
    full = np.zeros(len(sums), bool)
    full[cell[runs]] = True
    sums, full = sums.reshape(-1, 3), full.reshape(-1, 3)
    own = np.repeat(np.arange(len(which)), groups)
    room = need - np.bincount(own[full.sum(axis=1) < 2], minlength=len(which))
    number = np.arange(len(own)) - np.repeat(base // 3, groups)
    label = (band[own].astype(np.uint64) << np.uint64(40)) ^ (np.uint64(seed) << np.uint64(34))
    found, owners = [], []
    for subset, (i, j) in enumerate(combinations(range(3), 2)):
        some = full[:, i] | full[:, j]
        mark = label[some] ^ (3 * number[some] + subset).astype(np.uint64)
        found.append(mix64(sums[some, i] ^ mix64(sums[some, j] + mark * _B) ^ mark))
        owners.append(own[some])
    return np.concatenate(found), np.concatenate(owners), room


def parity_sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of SKETCH_BITS / 64 int64 words for each set."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = (mix64(h ^ _B) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(owner * SKETCH_BITS + cell, minlength=(len(bounds) - 1) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, SKETCH_BITS // 64)


def signature_rows(doc_ids: np.ndarray, h: np.ndarray, bounds: np.ndarray, bands: Bands) -> list[tuple]:
    """(key, doc, tag) array blocks of one slice, the sets' rows first, then exact copies (key: the first one), then signatures.

    A set's row also has its room: in any instance, the fewest groups that it must share
    with a partner beyond those that may be empty (0: nothing to spare).
    """
    sizes = np.diff(bounds)
    spread = mix64(doc_ids.astype(np.uint64)).view(np.int64)
    spare = np.full(len(sizes), ROOM_MAX)
    some = np.flatnonzero(sizes)
    sets = lambda: (spread, doc_ids, (((sizes << ROOM_BITS) + spare) << 2) + SET)
    if not len(some):
        return [sets()]
    blocks = []
    s1 = np.add.reduceat(mix64(h ^ _A), bounds[some])
    s2 = np.add.reduceat(mix64(h ^ _B), bounds[some])
    order = np.lexsort((doc_ids[some], s2, s1))
    lead = np.ones(len(some), bool)
    lead[1:] = (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
    leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(some)), 0))]
    copies, heads = some[order[~lead]], some[leader[~lead]]
    blocks.append((doc_ids[heads], doc_ids[copies], np.full(len(copies), COPY)))
    reps = some[order[lead]]
    tiny = reps[sizes[reps] <= bands.tiny_limit()]
    spare[tiny] = 0
    keys, docs = [], []
    for k in tiny.tolist():
        x = mix64(h[bounds[k] : bounds[k + 1]] ^ _A)
        total = int(x.sum(dtype=np.uint64))
        n = len(x)
        for out in range(n * (100 - bands.percent) // 100 + 1):
            for left in combinations(x.tolist(), out):
                keys.append((total - sum(left)) & ((1 << 64) - 1))
                docs.append(doc_ids[k])
    if keys:
        blocks.append((mix64(np.array(keys, np.uint64)).view(np.int64), np.array(docs, np.int64), np.full(len(keys), OWN)))
    big = reps[sizes[reps] >= MIN_PARTED]
    own_band = np.searchsorted(bands.edges, sizes[big], side="right") - 1
    for role, lower in ((OWN, 0), (GUEST, 1)):
        which, band = big[own_band >= lower], own_band[own_band >= lower] - lower
        for seed in range(SEEDS):
            if not len(which):
                break
            n = sizes[which]
            partner = np.minimum(n, bands.edges[band + 1] - 1) if lower else bands.largest(n)
            groups = bands.groups[band]
            need = groups - bands.differ(n, partner) // 2
            sig, own, room = _enumerated(h, bounds, which, groups, need, band, seed)
            spare[which] = np.minimum(spare[which], np.clip(room, 0, ROOM_MAX))
            blocks.append((sig.view(np.int64), doc_ids[which][own], np.full(len(own), role)))
            unsafe = room <= 0
            if seed == SEEDS - 1 and unsafe.any():
                rest = which[unsafe]
                blocks.append((mix64(band[unsafe].astype(np.uint64) + _B).view(np.int64), doc_ids[rest], np.full(len(rest), role)))
            which, band = which[unsafe], band[unsafe]
    return [sets(), *blocks]


def _emit_signatures(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, piece in text_slices(batch.column(1)):
                h, bounds = shingle_sets(piece, width)
                blocks = signature_rows(ids[first : first + len(piece)].astype(np.int64), h, bounds, bands)
                cols = [pa.array(np.concatenate([b[k] for b in blocks])) for k in range(3)]
                sketch = parity_sketches(h, bounds)
                ends = np.minimum(np.arange(len(cols[0]) + 1), len(piece)) * sketch.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sketch.ravel()))
                yield pa.RecordBatch.from_arrays([*cols, lists], names=["key", "doc", "tag", "words"])

    return run


def _rows(kind: int, a=None, b=None, c=None, members=None) -> pa.RecordBatch:
    n = len(members if members is not None else a)
    none = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(none if a is None else a, pa.int64()),
            pa.array(none if b is None else b, pa.int64()),
            pa.array(none if c is None else c).cast(pa.int32()),
            members if members is not None else pa.nulls(n, pa.list_(pa.int64())),
        ],
        names=["kind", "a", "b", "c", "members"],
    )


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for sizes[0] steps, then first[1], ..."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)


class _Buckets:
    """Buckets of one shuffle partition, from rows in key order; only the last key's rows and lists of small buckets are held."""

    def __init__(self):
        self.rest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        self.hot: int | None = None
        self.held: list[tuple] = []
        self.size = 0

    def add(self, key, doc, own) -> Iterator[pa.RecordBatch]:
        if self.hot is not None and len(key):
            more = int(np.argmin(key == self.hot)) if key[-1] != self.hot else len(key)
            if more:
                yield _rows(HOT_ROW, a=key[:more], b=doc[:more], c=own[:more])
            key, doc, own = key[more:], doc[more:], own[more:]
        if not len(key):
            return
        self.hot = None
        key, doc, own = (np.concatenate(x) for x in zip(self.rest, (key, doc, own), strict=True))
        cut = int(np.argmax(key == key[-1]))
        yield from self._settle(key[:cut], doc[:cut], own[:cut])
        key, doc, own = key[cut:], doc[cut:], own[cut:]
        if len(key) > 2 * HOT:
            self.hot = int(key[0])
            yield _rows(HOT_ROW, a=key, b=doc, c=own)
            key, doc, own = key[:0], doc[:0], own[:0]
        self.rest = key, doc, own

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._settle(*self.rest)
        yield from self._lists()

    def _settle(self, key, doc, own) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((~own, doc, key))
        key, doc, own = key[order], doc[order], own[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc, own = key[fresh], doc[fresh], own[fresh]
        if not len(key):
            return
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        runs = np.flatnonzero(new)
        length = np.diff(np.append(runs, len(key)))
        hosts = np.add.reduceat(own.astype(np.int64), runs)
        two = runs[(length == 2) & (hosts > 0)]
        if len(two):
            pairs = np.unique(np.stack([doc[two], doc[two + 1]], axis=1), axis=0)
            yield _rows(PAIR, a=pairs[:, 0], b=pairs[:, 1])
        hot = np.repeat((length > HOT) & (hosts > 0), length)
        if hot.any():
            yield _rows(HOT_ROW, a=key[hot], b=doc[hot], c=own[hot])
        mid = np.flatnonzero((length >= 3) & (length <= HOT) & (hosts > 0))
        if len(mid):
            marks = np.add.reduceat(mix64(mix64(doc.astype(np.uint64)) + own), runs)[mid]
            at = _ranges(runs[mid], length[mid])
            at = at[np.lexsort((~own[at], np.repeat(np.arange(len(mid)), length[mid])))]
            self.held.append((marks, hosts[mid], length[mid], doc[at]))
            self.size += len(at)
        if self.size > HELD:
            yield from self._lists()

    def _lists(self) -> Iterator[pa.RecordBatch]:
        """Distinct lists, hosts first (their number in b), with the times that each was found (c)."""
        if not self.held:
            return
        marks, hosts, sizes, doc = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        first = np.cumsum(sizes) - sizes
        marks, once, times = np.unique(marks, return_index=True, return_counts=True)
        sizes = sizes[once]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(doc[_ranges(first[once], sizes)]))
        yield _rows(BUCKET, a=marks.view(np.int64), b=hosts[once], c=times, members=lists)


def _find_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted shuffle partition: buckets of two as pairs, of 3 to HOT as lists, rows of larger ones; sets and copies pass."""
    found = _Buckets()
    for batch in batches:
        key, doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        kind = tag & 3
        at = np.flatnonzero(kind == SET)
        if len(at):
            known = tag[at] >> 2
            yield _rows(SIZE, a=doc[at], b=known >> ROOM_BITS, c=known & ROOM_MAX, members=batch.column(3).take(pa.array(at)))
        at = kind == COPY
        if at.any():
            yield _rows(SAME, a=doc[at], b=key[at])
        at = kind < SET
        yield from found.add(key[at], doc[at], kind[at] == OWN)
    yield from found.end()


def _jaccard(width: int, percent: int):
    """(a, b, text_a, text_b) -> (a, b, inter, total, linked); a's set is kept while a repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for first, piece in text_slices(batch.column(3)):
                h, bounds = shingle_sets(piece, width)
                left = batch.column(0).slice(first, len(piece)).to_pylist()
                texts = batch.column(2).slice(first, len(piece))
                inter, total = [], []
                for k, a in enumerate(left):
                    if a != last or last is None:
                        kept, _ = shingle_sets(pa.array([texts[k].as_py()], pa.large_string()), width)
                        last = a
                    other = h[bounds[k] : bounds[k + 1]]
                    common = len(np.intersect1d(kept, other, assume_unique=True))
                    inter.append(common)
                    total.append(len(kept) + len(other) - common)
                i, u = np.array(inter, np.int64), np.array(total, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(piece)), batch.column(1).slice(first, len(piece)), pa.array(i), pa.array(u), pa.array((100 * i >= percent * u) & (u > 0))],
                    names=["a", "b", "inter", "total", "linked"],
                )

    return run


def verify(docs: DataFrame, pairs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Exact Jaccard of the candidate pairs (a, b): a, b, inter, total, linked.  docs: doc_id, text, without nulls."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = flag_ids(docs, ids, "maybe").where("maybe")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(frugal(_jaccard(width, percent)), "a long, b long, inter long, total long, linked boolean")


def _similar_sketches(l: str, r: str, percent: int) -> Column:
    """Sizes (n) and sketches (words) of two aliases allow the similarity."""
    n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
    bits = (F.bit_count(F.col(f"{l}.words")[k].bitwiseXOR(F.col(f"{r}.words")[k])) for k in range(SKETCH_BITS // 64))
    return (n * percent <= m * 100) & (m * percent <= n * 100) & (reduce(add, bits) * (100 + percent) <= (n + m) * (100 - percent))


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that sizes and sketches allow."""
    with_a = pairs.join(sizes.select(F.col("doc").alias("a"), F.struct("n", "words").alias("x")), "a")
    both = with_a.join(sizes.select(F.col("doc").alias("b"), F.struct("n", "words").alias("y")), "b")
    return both.where(_similar_sketches("x", "y", percent)).select("a", "b").distinct()


def _shared_rows(found: DataFrame, rooms: DataFrame) -> DataFrame:
    """(bucket, doc, own, times): documents in buckets of three or more that are not safe; times: signatures that the bucket stands for.

    A document is safe while it shares fewer signatures with two or more others than its
    room: then it meets every partner in a bucket of two, which is compared anyway.
    """
    lists = found.where(f"kind = {BUCKET}").groupBy(F.col("a").alias("bucket")).agg(F.sum("c").alias("times"), F.first("b").alias("hosts"), F.first("members").alias("members"))
    lists = lists.select("bucket", "times", "hosts", F.posexplode("members").alias("at", "doc")).select("bucket", "times", "doc", (F.col("at") < F.col("hosts")).alias("own"))
    hot = found.where(f"kind = {HOT_ROW}").select(F.col("a").alias("bucket"), F.lit(1).cast("long").alias("times"), F.col("b").alias("doc"), (F.col("c") == 1).alias("own"))
    rows = lists.unionByName(hot.distinct())
    unsafe = rows.groupBy("doc").agg(F.sum("times").alias("shared")).join(rooms, "doc").where("shared >= room").select("doc")
    return rows.select("bucket", "doc", "own", "times").join(unsafe, "doc", "left_semi")


def _stars(rows: DataFrame) -> DataFrame:
    """(bucket, doc, own, times, center): the smallest document of each bucket that is no guest is its centre."""
    middle = rows.groupBy("bucket").agg(F.min(F.when(F.col("own"), F.col("doc"))).alias("center"), F.count("*").alias("members"))
    return rows.join(middle.where("center is not null and members > 1").select("bucket", "center"), "bucket")


def _left_apart(stars: DataFrame, labels: DataFrame, rooms: DataFrame) -> DataFrame:
    """(bucket, doc, own, component, before) of every bucket that still holds more than one component.

    A document leaves out its largest buckets, as long as they stand for fewer signatures
    than its room (all order buckets alike, so the smallest bucket that a pair shares is
    kept by both).  before: the next smaller buckets of the document, up to BEFORE.
    """
    rows = stars.select("bucket", "doc", "own", "times").join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc"))
    ends = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x != y")
    rows = rows.join(ends.select("bucket", "members"), "bucket").join(rooms, "doc")
    order = Window.partitionBy("doc").orderBy(F.desc("members"), "bucket")
    rows = rows.withColumns({"hottest": F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0)), "before": F.collect_list("bucket").over(order.rowsBetween(1, BEFORE))})
    return rows.where("hottest >= room").select("bucket", "doc", "own", "component", "before")


def _across(apart: DataFrame, sizes: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a signature but are still in different components, if sizes and sketches allow their similarity.

    A pair is left to an earlier bucket that both have (a row of its smallest one always stays).
    """
    rows = apart.join(sizes.select("doc", "n", "words"), "doc")
    l, r = rows.alias("l"), rows.alias("r")
    once = F.when(F.col("r.own"), F.col("l.component") < F.col("r.component")).otherwise(F.col("l.component") != F.col("r.component"))
    pairs = l.where("own").join(r, "bucket").where(once & _similar_sketches("l", "r", percent) & ~F.arrays_overlap("l.before", "r.before"))
    pairs = pairs.select(F.least("l.doc", "r.doc").alias("a"), F.greatest("l.doc", "r.doc").alias("b")).distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents joined by chains of Jaccard >= percent/100.

    docs: doc_id, text; other columns are ignored.  A null or empty text has no shingle and
    is its own component; a text of fewer than ``width`` words is one shingle.  Rows that
    repeat a doc_id are one node (each is returned).  A null doc_id is returned with a null
    component and takes no part.  An empty table gives an empty result.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    real = thin.where("doc_id is not null")
    signatures = real.mapInArrow(frugal(_emit_signatures(width, percent)), SIG_SCHEMA).repartition("key").sortWithinPartitions("key")
    found = written(signatures.mapInArrow(frugal(_find_buckets), FOUND_SCHEMA), "buckets")
    sizes = found.where(f"kind = {SIZE}").select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("room"), F.col("members").alias("words"))
    rooms = sizes.groupBy("doc").agg(F.min("room").alias("room"))
    stars = written(_stars(_shared_rows(found, rooms)), "stars")
    pairs = found.where(f"kind = {PAIR}").select("a", "b").unionByName(stars.where("center != doc").select(F.col("center").alias("a"), F.col("doc").alias("b")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = written(verify(real, written(_possible(pairs, sizes, percent), "pairs"), width, percent), "tested")
    same = found.where(f"kind = {SAME}").select("a", "b")
    edges = same.unionByName(tested.where("linked").select("a", "b"))
    labels = written(components(edges), "labels")
    apart = written(_left_apart(stars, labels, rooms), "apart")
    if not apart.isEmpty():
        more = written(verify(real, written(_across(apart, sizes, tested, percent), "across"), width, percent), "tested")
        more = more.where("linked")
        if not more.isEmpty():
            edges = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))
            labels = written(components(edges), "labels")
    result = sizes.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"))
    result = result.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    result = result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    lost = thin.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(lost)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest doc_id; same columns.

    Of rows that repeat a doc_id one stays.  Rows without a doc_id and texts without words
    are linked with nothing and stay.  Rows that cannot be concerned are not shuffled.
    """
    groups = written(jaccard_components(docs, width, percent), "groups").where("doc_id is not null")
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias("id"))
    repeated = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    maybe, text, first = (fresh_name() for _ in range(3))
    flagged = flag_ids(docs, gone.unionByName(repeated), maybe)
    sure = flagged.where(~F.col(maybe)).drop(maybe)
    unsure = flagged.where(F.col(maybe)).drop(maybe).join(gone.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    unsure = unsure.withColumn(text, F.xxhash64("text")).withColumn(first, F.row_number().over(Window.partitionBy("doc_id").orderBy(text)))
    return sure.unionByName(unsure.where(F.col(first) == 1).select(*(F.col(f"`{c}`") for c in docs.columns)))
