"""N-gram Jaccard self-join by grouped prefixes, and the components of its links.

A document's set holds its distinct 4-word shingles as 64-bit keys, the rarest first: the top bits
of a key are a frequency class from a fixed-size count sketch over the whole corpus, the rest a hash.
Two sets link if ``100 * |A & B| >= 85 * |A | B|``.  Then a short prefix of the smaller set and a prefix
of the larger have a key in common, which gives the plan:

1. Documents with equal sets are one class; classes with identical prefixes and size are one
   group.  Only one posting a group, key and task goes into the shuffle.
2. Postings meet by key, in order of size.  Groups next to each other (two steps at most) are
   candidates, if sizes and places in the sets allow a link; so are neighbours inside a group.
3. Candidates are verified on their whole sets, and links give components.
4. Keys that more than three groups share may hide links between groups that were not neighbours.
   Such pairs matter only between *different* components. Two rounds try neighbours in random orders,
   which joins nearly all that belong together; then every pair left between different components
   that share a key is listed (components first, then their members), expanded to classes and
   verified.

So no link between unlike texts is lost.  Copies are never paired all with all, nor are members of one component.  What is compared
without a link is pairs of groups in different components that share a key of their prefixes: a family of texts that are nearly, but not
quite, near copies of each other (just under the limit, all of them) has them all compared, in blocks, with the square of its size.

Hot keys: a key whose shingle the sketch finds in more than ``HOT`` documents is dealt out to several tasks by group, so a task holds
about that many of its postings; later joins by key are salted by its number of postings.  Joins by component are left to
Spark's splitting of skewed partitions.  At very large corpora the noise of the sketch's counters (the root of their mean load) hides
which shingles are rarer among the rare; that costs candidates, never links.

Contract: null text or text without words has the empty set and links with nothing; a text of one to
three words has the whole sequence as its shingle; repeated rows are exact copies; a null id is
linked like others but never names a component (it is null only if no member has an id).  Other
columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planewise.llm.common import remove, shuffle_partitions, trimmed, written
from planewise.llm.components import connected_components
from planewise.llm.textbuf import U64, Slice, each_slice, mix, window_hashes

_FIRST = -(1 << 63)
#: Counters of the sketch: 2 to this power, whatever the corpus.
SKETCH_BITS = 22
_BLOCK = 1 << 16
#: Bits of the filter of candidate classes, at most.
FILTER_BITS = 28
#: Rounds of random neighbours, and how many places apart they are at most.
_ROUNDS, _NEIGHBOURS = 2, 6
#: Postings of one key that are compared with each other at a time.
_PAIR_BLOCK = 1024
#: Parts that the keys of one component are dealt to.
_HOMES = 16
_POST = np.dtype([("key", "<u8"), ("grp", "<i8"), ("n", "<u4"), ("at", "<u2")])
#: The same with the number of postings of the key.
_RUN = np.dtype([*_POST.descr, ("held", "<u4")])
#: Documents of a shingle from which on its key is dealt out.
HOT = 1 << 20
#: Postings of a key that share a salt.
_SALTED = 1024


def shingles(s: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of the distinct shingles, sorted by document and hash."""
    start, end, doc = s.words()
    h = s.hashes(start, end)
    g, at = window_hashes(h, doc, size)
    d = doc[at]
    words = np.bincount(doc, minlength=s.n)
    few = np.flatnonzero((words > 0) & (words < size))
    if len(few):
        first = np.searchsorted(doc, few)
        whole = np.array([hash_sequence(h[a : a + words[k]]) for a, k in zip(first, few, strict=True)], U64)
        at = np.searchsorted(d, few)
        g, d = np.insert(g, at, whole), np.insert(d, at, few)
    g = sorted_by_doc(g, d, s.n)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], d[new]


def sorted_by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Values sorted inside each document; ``doc`` ascends."""
    out = values.copy()
    edge = np.searchsorted(doc, np.arange(n + 1)).tolist()
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        out[a:z].sort()
    return out


def hash_sequence(h: np.ndarray) -> int:
    out = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * U64(0xC2B2AE3D27D4EB4F) + x
    return int(mix(np.array([out], U64) ^ U64(0x5851F42D4C957F2D))[0])


def _digest(keys: np.ndarray, doc: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit digest of each document's sorted keys: sums of two mixes, with the size."""
    first = np.searchsorted(doc, np.arange(n + 1))
    out = np.diff(first).astype(U64) * U64(0x9E3779B97F4A7C15)
    for k in (1, 2):
        cum = np.zeros(len(keys) + 1, U64)
        np.cumsum(mix(keys ^ U64((salt * 4 + k) * 0x632BE59BD9B4E019 & (1 << 64) - 1)), out=cum[1:])
        out = mix(out ^ (cum[first[1:]] - cum[first[:-1]]) * U64(0xD6E8FEB86659FD93 + 2 * k))
    return out.view(np.int64)


class Order:
    """The global order of shingles: by frequency class (8 bits), then by hash; one 64-bit key each."""

    def __init__(self, ranks: np.ndarray, mean: float = 1.0):
        self.ranks = ranks
        # about the load of a counter of each class, and the tasks its keys are dealt out to
        z = np.where(np.arange(256) < 127, np.arange(256) / 4 - 8, 24 * 2.0 ** ((np.arange(256) - 127) / 4))
        self.tasks = np.maximum(1, np.ceil((mean + (z + 1) * np.sqrt(mean)) / HOT)).astype(U64)

    def sets(self, s: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
        g, d = shingles(s, size)
        keys = (self.ranks[g >> U64(64 - SKETCH_BITS)].astype(U64) << U64(56)) | (mix(g) >> U64(8))
        return sorted_by_doc(keys, d, s.n), d


def frequency_order(texts: DataFrame, size: int) -> Order:
    """Count all shingles of all documents into a sketch of fixed size.

    A counter holds the mean load of rare shingles, spread by its root, and the frequent ones that fall into it.
    Classes are quarters of that spread about the mean, and quarter octaves far above it: a shingle of a few documents
    more already stands behind most of those of one, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        one = np.uint32(1)
        for batch in batches:
            for _, _, s in each_slice(batch[0], lower=True):
                np.add.at(total, shingles(s, size)[0] >> U64(64 - SKETCH_BITS), one)
        if total.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.astype("<u8").tobytes(), 1)], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    parts = min(64, shuffle_partitions(texts.sparkSession))
    load = np.zeros(1 << SKETCH_BITS)
    for r in texts.mapInArrow(trimmed(count), kind).repartition(parts, "block").mapInArrow(trimmed(add), kind).collect():
        load[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    mean = max(1.0, load.mean())
    z = (load - mean) / np.sqrt(mean)
    fine, coarse = np.floor(4 * z) + 32, 127 + 4 * np.log2(np.maximum(z / 24, 1))
    return Order(np.clip(np.where(z < 24, fine, coarse), 0, 255).astype(np.uint8), mean)


def probe_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def index_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether postings of one key can belong to a link first met there; ``a`` is not larger than ``b``."""
    an, bn = a["n"].astype(np.int64), b["n"].astype(np.int64)
    aa, ba = a["at"].astype(np.int64), b["at"].astype(np.int64)
    # places from 65,535 on are stored as that
    left = np.minimum(an - aa, bn - ba)
    return (a["grp"] != b["grp"]) & (aa < np.minimum(index_length(an, percent), 65_536)) & (100 * an >= percent * bn) & ((100 + percent) * left >= percent * (an + bn))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([lo, hi], axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.binary())], names=["u", "v", "run"])


class NgramJoin:
    """The steps of the join over one table; ``links`` and ``components`` run it."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85):
        self.percent, self.size = percent, size
        self.spark = docs.sparkSession
        doc_id = F.col(id_col).cast("long")
        self.rows = docs.select(F.coalesce(doc_id, F.lit(_FIRST)).alias("k"), F.col(text_col).cast("string").alias("text"))
        self.parts = 4 * shuffle_partitions(self.spark)

    # -- sets ----------------------------------------------------------------------------------

    def _classes(self) -> DataFrame:
        """Of each document (k, n, cls, grp, prefix); prefix is the packed probe prefix."""
        order, size, percent = self.order, self.size, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, s in each_slice(batch[1], lower=True):
                    keys, doc = order.sets(s, size)
                    first = np.searchsorted(doc, np.arange(s.n + 1))
                    n = np.diff(first)
                    cls = _digest(keys, doc, s.n, 1)
                    place = np.arange(len(keys)) - first[doc]
                    head = place < probe_length(n, percent)[doc]
                    grp = _digest(keys[head], doc[head], s.n, 2) ^ mix(n.astype(U64) + U64(7)).view(np.int64)
                    cut = np.searchsorted(doc[head], np.arange(1, s.n))
                    blobs = [x.tobytes() for x in np.split(keys[head], cut)]
                    yield pa.RecordBatch.from_arrays([batch[0].slice(i, j - i), pa.array(n, pa.int64()), pa.array(cls), pa.array(grp), pa.array(blobs, pa.binary())], names=["k", "n", "cls", "grp", "prefix"])

        return self.rows.mapInArrow(trimmed(run), "k long, n long, cls long, grp long, prefix binary")

    def _candidates(self, table: DataFrame) -> DataFrame:
        """Rows (u, v): neighbouring groups under a key; rows (run): packed postings of keys with over three groups."""
        parts, percent, tasks = self.parts, self.percent, self.order.tasks

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                n, grp, prefix = batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()
                for lo in range(0, len(n), 2048):
                    mine = []
                    for i in range(lo, min(lo + 2048, len(n))):
                        if grp[i] not in seen:
                            seen.add(grp[i])
                            mine.append(i)
                    if len(seen) > 1_000_000:  # a repeat is merged later
                        seen.clear()
                    sizes = [len(prefix[i]) // 8 for i in mine]
                    x = np.empty(sum(sizes), _POST)
                    x["key"] = np.frombuffer(b"".join(prefix[i] for i in mine), "<u8")
                    x["grp"], x["n"] = np.repeat(np.array([grp[i] for i in mine], np.int64), sizes), np.repeat(np.array([n[i] for i in mine], np.int64), sizes)
                    x["at"] = np.minimum(np.concatenate([np.arange(k) for k in sizes] or [np.zeros(0)]), 65_535)
                    salt = mix(x["grp"].view(U64)) % tasks[(x["key"] >> U64(56)).astype(np.int64)]
                    part = (mix(x["key"] + salt * U64(0x9E3779B97F4A7C15)) % U64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    x, part = x[order], part[order]
                    names, at = np.unique(part, return_index=True)
                    if len(names):
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([b.tobytes() for b in np.split(x, at[1:])], pa.binary())], names=["part", "posts"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def solve(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                x = np.concatenate(held)
                x = x[np.lexsort((x["grp"], x["n"], x["key"]))]
                x = x[np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["grp"][1:] != x["grp"][:-1])])]
                us, vs = [], []
                for lag in (1, 2):
                    a, b = x[:-lag], x[lag:]
                    ok = np.flatnonzero(a["key"] == b["key"])
                    ok = ok[_possible(a[ok], b[ok], percent)]
                    us.append(a["grp"][ok])
                    vs.append(b["grp"][ok])
                pairs = _pairs(np.concatenate(us), np.concatenate(vs))
                if pairs.num_rows:
                    yield pairs
                head = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]]))
                length = np.diff(np.append(head, len(x)))
                # of a key that was dealt out others may be elsewhere
                dealt = tasks[(x["key"][head] >> U64(56)).astype(np.int64)].astype(np.int64)
                length = np.where(dealt > 1, np.maximum(4, length * dealt), length)
                held = np.repeat(length, np.diff(np.append(head, len(x))))
                long = np.empty(int((held > 3).sum()), _RUN)
                for name in _POST.names:
                    long[name] = x[name][held > 3]
                long["held"] = np.minimum(held[held > 3], (1 << 32) - 1)
                for i in range(0, len(long), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([long[i : i + (1 << 16)].tobytes()], pa.binary())], names=["u", "v", "run"])

            now, held = None, []
            for batch in batches:
                for part, blob in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    if part != now and held:
                        yield from solve(held)
                        held = []
                    now = part
                    held.append(np.frombuffer(blob, _POST))
            if held:
                yield from solve(held)

        posts = table.where("n > 0").select("n", "grp", "prefix").mapInArrow(trimmed(post), "part int, posts binary")
        met = posts.repartition("part").sortWithinPartitions("part")
        return met.mapInArrow(trimmed(meet), "u long, v long, run binary")

    # -- verification --------------------------------------------------------------------------

    def _sets_of(self, classes: DataFrame) -> DataFrame:
        """(cls, keys) of the wanted classes (k, cls), recomputed from the texts and written.

        They are picked by a bit filter of bounded size, so some others come along: those join with nothing.
        """
        order, size = self.order, self.size
        bits = min(FILTER_BITS, max(16, (256 * classes.count()).bit_length()))

        def place(k: np.ndarray, cls: np.ndarray) -> np.ndarray:
            return (mix(cls.view(U64) ^ mix(k.view(U64))) >> U64(64 - bits)).astype(np.int64)

        def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.zeros(1 << bits, bool)
            for batch in batches:
                on[place(np.array(batch[0].to_pylist(), np.int64), np.array(batch[1].to_pylist(), np.int64))] = True
            packed = np.packbits(on).reshape(16, -1)
            some = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(packed) if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], names=["block", "flags"])

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, p in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    held[i] = held.get(i, 0) | np.frombuffer(zlib.decompress(p), np.uint8)
            for i, p in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1)], pa.binary())], names=["block", "flags"])

        kind = "block int, flags binary"
        packed = np.zeros((16, (1 << bits) // 128), np.uint8)
        for r in classes.select("k", "cls").mapInArrow(trimmed(flags), kind).repartition(16, "block").mapInArrow(trimmed(unite), kind).collect():
            packed[r["block"]] = np.frombuffer(zlib.decompress(r["flags"]), np.uint8)
        squeezed = zlib.compress(packed.tobytes(), 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.frombuffer(zlib.decompress(squeezed), np.uint8)
            for batch in batches:
                k = np.array(batch[0].to_pylist(), np.int64)
                for i, j, s in each_slice(batch[1], lower=True):
                    keys, doc = order.sets(s, size)
                    cls = _digest(keys, doc, s.n, 1)
                    first = np.searchsorted(doc, np.arange(s.n + 1))
                    at = place(k[i:j], cls)
                    take = np.flatnonzero((wanted[at >> 3] << (at & 7).astype(np.uint8) & 128).astype(bool) & (np.diff(first) > 0))
                    if len(take):
                        # 48 bits of a key's hash are enough within one pair of sets
                        blobs = [np.ascontiguousarray(keys[first[t] : first[t + 1]].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for t in take]
                        yield pa.RecordBatch.from_arrays([pa.array(cls[take]), pa.array(blobs, pa.binary())], names=["cls", "keys"])

        return written(self.rows.mapInArrow(trimmed(run), "cls long, keys binary"), "sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (u, v) of classes that link."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for a, b in zip(batch[2], batch[3], strict=True):
                    x, y = (np.frombuffer(z.as_buffer(), "S6") for z in (a, b))
                    x, y = (np.frombuffer(np.concatenate([z.view(np.uint8).reshape(-1, 6), np.zeros((len(z), 2), np.uint8)], axis=1).tobytes(), "<u8") for z in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

        left = pairs.join(sets.toDF("u", "a"), "u")
        return left.join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(trimmed(run), "u long, v long")

    # -- the whole ---------------------------------------------------------------------------

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(documents: k, n, cls; stars: u, v) with classes as nodes."""
        self.order = frequency_order(self.rows.select("text"), self.size)
        wide = written(self._classes(), "prefixes")
        table = written(wide.select("k", "n", "cls", "grp"), "classes")
        classes = written(table.where("n > 0").groupBy("cls").agg(F.min("k").alias("k"), F.min("grp").alias("grp")), "members")
        found = written(self._candidates(wide), "candidates")
        remove(wide)
        near = written(found.where("u IS NOT NULL").select("u", "v").distinct(), "near")
        runs = written(found.where("run IS NOT NULL").select("run").mapInArrow(trimmed(_unpacked), "key long, grp long, n long, at long, salt int"), "runs")
        remove(found)

        # neighbours: between groups by their first classes, and inside each group
        reps = classes.groupBy("grp").agg(F.min("cls").alias("cls"))
        first = near.join(reps.toDF("u", "a"), "u").join(reps.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        inside = classes.withColumn("v", F.lead("cls").over(Window.partitionBy("grp").orderBy("cls"))).where("v IS NOT NULL").select(F.col("cls").alias("u"), "v")
        tried = written(_ordered(first.union(inside)).distinct(), "tried")
        sets = self._sets_of(self._of(classes, "cls", tried.select("u").union(tried.select("v"))))
        stars = connected_components(self._verified(tried, sets))
        remove(sets)

        # what may still hide a link: groups that share a key across components, and groups of several classes with their neighbours
        cells, posts = self._mixed(runs, classes, stars)
        several = classes.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1").select("grp")
        beside = near.toDF("ga", "gb")
        beside = beside.join(several.toDF("ga"), "ga", "left_semi").select("ga", "gb").union(beside.join(several.toDF("gb"), "gb", "left_semi").select("ga", "gb"))
        beside = written(beside.union(several.select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))).distinct(), "beside")
        if not _any(posts) and not _any(beside):
            for x in (tried, posts, runs, near, beside, classes, cells):
                remove(x)
            return table, stars
        open_ = written(self._across(posts, pairs=False).distinct(), "open")
        runs = written(runs.join(open_, "grp", "left_semi").select(*runs.columns), "runs")
        posts = posts.join(open_, "grp", "left_semi").select(*posts.columns)
        sets = self._sets_of(self._of(classes, "grp", open_.select("grp").union(beside.select("ga")).union(beside.select("gb"))))
        for turn in range(_ROUNDS):
            if not _any(posts):
                break
            pairs = _ordered(self._random_neighbours(posts, turn).join(cells.toDF("ga", "ca", "u"), ["ga", "ca"]).join(cells.toDF("gb", "cb", "v"), ["gb", "cb"])).distinct()
            more = written(pairs.join(tried, ["u", "v"], "left_anti"), "more")
            if not _any(more):
                break
            stars = self._merged(stars, more, sets)
            tried = written(tried.union(more), "tried")
            cells, posts = self._mixed(runs, classes, stars)
        if _any(posts) or _any(beside):
            rest = written(self._remaining(beside, posts, cells, classes, stars).join(tried, ["u", "v"], "left_anti"), "rest")
            if _any(rest):
                stars = self._merged(stars, rest, sets)
            remove(rest)
        for x in (tried, sets, runs, near, beside, open_, classes, cells):
            remove(x)
        return table, stars

    @staticmethod
    def _of(classes: DataFrame, column: str, values: DataFrame) -> DataFrame:
        return classes.join(values.toDF(column).distinct(), column, "left_semi").select("k", "cls")

    def _merged(self, stars: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return connected_components(stars.union(self._verified(pairs, sets)))

    @staticmethod
    def _labelled(classes: DataFrame, stars: DataFrame) -> DataFrame:
        return classes.join(stars.toDF("cls", "root"), "cls", "left").select("grp", "cls", F.coalesce("root", "cls").alias("comp"))

    def _mixed(self, runs: DataFrame, classes: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cells (grp, comp, cls: the first member), and the postings (key, grp, n, at, comp, held) of keys that different components hold."""
        cells = written(self._labelled(classes, stars).groupBy("grp", "comp").agg(F.min("cls").alias("cls")), "cells")
        posts = runs.join(cells.select("grp", "comp"), "grp")
        keys = posts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held"), F.max("salt").alias("salts")).where("lo != hi")
        # one row a salt of the key, so that the postings of a hot key meet it in several tasks
        keys = keys.select("key", "held", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
        return cells, written(posts.join(keys, ["key", "salt"]).select("key", "grp", "n", "at", "comp", "held"), "mixed")

    def _possible_columns(self, a: tuple[str, str], b: tuple[str, str]) -> Column:
        """Sizes and places of two postings that allow a link."""
        (an, aa), (bn, ba) = ((F.col(n), F.col(at)) for n, at in (a, b))
        left = F.least(an - aa, bn - ba)
        return (100 * F.least(an, bn) >= self.percent * F.greatest(an, bn)) & ((100 + self.percent) * left >= self.percent * (an + bn))

    def _random_neighbours(self, posts: DataFrame, turn: int) -> DataFrame:
        """(ga, ca, gb, cb): a few places apart in a random order of a key's postings; keys of many postings are dealt out in parts."""
        h = F.xxhash64(F.lit(turn), "key", "grp")
        some = posts.withColumn("h", h).withColumn("part", F.pmod("h", F.ceil(F.col("held") / 128).cast("long")))
        w = Window.partitionBy("key", "part").orderBy("h", "grp", "comp")
        other = F.struct(F.col("grp").alias("gb"), F.col("comp").alias("cb"), F.col("n").alias("n2"), F.col("at").alias("at2"))
        after = F.array(*(F.lead(other, k).over(w) for k in range(1, _NEIGHBOURS + 1)))
        rows = some.select(F.col("grp").alias("ga"), F.col("comp").alias("ca"), "n", "at", after.alias("after"))
        rows = rows.select("ga", "ca", "n", "at", F.inline(F.filter("after", lambda x: x.isNotNull())))
        return rows.where((F.col("ca") != F.col("cb")) & self._possible_columns(("n", "at"), ("n2", "at2"))).select("ga", "ca", "gb", "cb").distinct()

    def _across(self, posts: DataFrame, pairs: bool = True) -> DataFrame:
        """(ga, ca, gb, cb): groups in different components that share a key and may link; without ``pairs`` only the groups (grp) that have such a partner.

        The postings of a key are packed in blocks of a bounded size, and each pair of blocks is one row.  Rows go to
        tasks by the component that holds most of their key, in ``_HOMES`` parts, so many of the keys that one family of texts shares
        meet, and a pair that many of them show is listed a few times only; blocks of large keys are dealt out each for itself.
        """
        percent = self.percent
        home = posts.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("home"))
        part = F.pmod(F.xxhash64(F.lit("block"), "grp"), F.ceil(F.col("held") / _PAIR_BLOCK).cast("long"))
        blocks = posts.select("key", part.alias("block"), F.struct("grp", "comp", "n", "at").alias("post")).groupBy("key", "block").agg(F.collect_list("post").alias("posts"))
        both = blocks.toDF("key", "a", "pa").join(blocks.toDF("key", "b", "pb"), "key").where("a <= b").join(home, "key").select("home", F.pmod(F.xxhash64("key"), F.lit(_HOMES)).alias("deal"), "a", "b", "pa", F.when(F.col("a") != F.col("b"), F.col("pb")).alias("pb"))
        dealt = both.repartition("home", "deal", "a", "b").sortWithinPartitions("home").select("home", "pa", "pb")

        def unpack(lists: pa.Array) -> np.ndarray:
            flat = lists.as_py()
            return np.array([(p["grp"], p["comp"], p["n"], p["at"]) for p in flat], np.int64).reshape(-1, 4)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            now = None

            def out() -> Iterator[pa.RecordBatch]:
                rows = np.unique(np.concatenate(held), axis=0)
                held.clear()
                if not pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(rows[:, [0, 2]]))], names=["grp"])
                elif len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["ga", "ca", "gb", "cb"])

            for batch in batches:
                for home, x, y in zip(batch[0].to_pylist(), batch[1], batch[2], strict=True):
                    if held and (home != now or sum(map(len, held)) > 1 << 20):
                        yield from out()
                    now = home
                    a = unpack(x)
                    b = unpack(y) if y.is_valid else a
                    for left, right in [(a[a[:, 1] != home], b)] + ([(b[b[:, 1] != home], a)] if y.is_valid else []):
                        held.append(_crossing(left, right, percent))
            if held:
                yield from out()

        return dealt.mapInArrow(trimmed(run), "ga long, ca long, gb long, cb long" if pairs else "grp long")

    def _remaining(self, beside: DataFrame, posts: DataFrame, cells: DataFrame, classes: DataFrame, stars: DataFrame) -> DataFrame:
        """(u, v): all pairs of classes in different components that share a key or a group and may link."""
        pairs = self._across(posts)
        # groups of several classes, of which neighbours have met the first one only
        cell = cells.select("grp", "comp")
        split = beside.join(cell.toDF("ga", "ca"), "ga").join(cell.toDF("gb", "cb"), "gb").where("ca != cb")
        whole = pairs.select("ga", "ca", "gb", "cb").union(split.select("ga", "ca", "gb", "cb")).distinct()
        node = self._labelled(classes, stars)
        both = whole.join(node.toDF("ga", "u", "ca"), ["ga", "ca"]).join(node.toDF("gb", "v", "cb"), ["gb", "cb"])
        return _ordered(both).distinct()


def _crossing(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Rows (ga, ca, gb, cb), ga < gb, of postings (grp, comp, n, at) in different components that may link."""
    found = [np.zeros((0, 4), np.int64)]
    for i in range(0, len(left), 256):
        x, y = left[i : i + 256, None, :], right[None, :, :]
        an, bn = x[:, :, 2], y[:, :, 2]
        ok = (x[:, :, 1] != y[:, :, 1]) & (x[:, :, 0] != y[:, :, 0]) & (100 * np.minimum(an, bn) >= percent * np.maximum(an, bn))
        ok &= (100 + percent) * np.minimum(an - x[:, :, 3], bn - y[:, :, 3]) >= percent * (an + bn)
        p, q = np.nonzero(ok)
        one, two = left[i + p][:, :2], right[q][:, :2]
        swap = (one[:, 0] > two[:, 0])[:, None]
        found.append(np.concatenate([np.where(swap, two, one), np.where(swap, one, two)], axis=1))
    return np.concatenate(found)


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch[0].to_pylist():
            x = np.frombuffer(blob, _RUN)
            # salts 0 to ceil(held / _SALTED) - 1
            salt = mix(np.ascontiguousarray(x["grp"]).view(U64)) % (-(-x["held"].astype(np.int64) // _SALTED)).astype(U64)
            cols = [pa.array(np.ascontiguousarray(x["key"]).view(np.int64)), pa.array(x["grp"]), pa.array(x["n"].astype(np.int64)), pa.array(x["at"].astype(np.int64)), pa.array(salt.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "grp", "n", "at", "salt"])


def component_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    table, stars = NgramJoin(docs, id_col, text_col, size, percent).run()
    known = F.when(F.col("k") != _FIRST, F.col("k"))
    rows = table.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    least = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(stars.toDF("cls", "root"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    # only linked classes need the smallest id of their component
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(roots, "root").select("cls", "component_id")
    out = rows.join(names, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
