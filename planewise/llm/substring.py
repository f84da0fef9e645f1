"""Substring deduplication by content-defined chunks.

Texts are cut into variable chunks that start at words (far from any, at code points) chosen by a gear
rolling hash over the last 16 bytes, so equal passages fall into equal chunks whatever stands before them.  The unit is a
*run*: from each chunk on, the consecutive chunks of one text that together reach ``least_run`` bytes.  Of runs
with equal digests (96 bits) the first is kept (smallest id, then place); later ones that do not overlap it in their own text are
deleted.  So what goes stands elsewhere as a whole, and phrases that were seen apart never add up to a repeat.

* Each task keeps at most one occurrence of a digest per flush for the shuffle, the others are
  already known not to be first: a passage of a third of all documents sends a few rows a task.
* Digests meet in buckets as packed arrays; only the runs found to repeat go back to their texts, each with a hash of
  the document and the chunk number of its first occurrence: a span goes on only as long as its source does.

Contract: null text stays null; rows equal in id and text are one document (nothing in one is
a repeat of the other); a null id sorts first; equal ids with unlike texts are separate documents; texts are read whole, those
under ``least_run`` bytes have no runs.  A text can become nearly empty, the row stays.  Empty tables give empty results; other columns
are passed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.chunking import Chunking
from planewise.llm.common import shuffle_partitions, trimmed
from planewise.llm.textbuf import U64, each_slice, mix

#: Small chunks, so that passages of fifty words hold several whatever their ends are cut to.
CHUNKS = Chunking(least=16, normal=20, most=160, strict_bits=2, loose_bits=1, at_words=True)
_POST = np.dtype([("digest", "<u8"), ("more", "<u4"), ("hash", "<i4"), ("doc", "<i8"), ("at", "<u4")])
#: A run that repeats: its chunk number, and its first occurrence's document (hashed) and chunk number.
_MARK = np.dtype([("at", "<u4"), ("source", "<u4"), ("there", "<u4")])
_FLUSH = 1 << 19
_FIRST = -(1 << 63)


def _document(doc: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """A 32-bit name of a document."""
    return (mix(doc.astype(np.int64).view(U64) * U64(3) + text_hash.astype(np.int64).view(U64)) >> U64(32)).astype(np.uint32)


def runs(start: np.ndarray, end: np.ndarray, doc: np.ndarray, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first chunk, last chunk, digest, second digest) of the shortest run of at least ``least`` bytes from each chunk on, where the text has one."""
    n = len(doc)
    last = np.searchsorted(end, start + least)  # chunks tile the slice, so ends ascend
    at = np.flatnonzero(last < n)
    at = at[doc[last[at]] == doc[at]]
    last = last[at]
    total = hashes[at].copy()
    more = mix(hashes[at] ^ U64(0x9E3779B97F4A7C15))
    for k in range(1, int((last - at).max(initial=0)) + 1):
        on = np.flatnonzero(last - at >= k)
        h = hashes[at[on] + k]
        total[on] = total[on] * U64(0xC2B2AE3D27D4EB4F) + h
        more[on] = more[on] * U64(0x165667B19E3779F9) + mix(h ^ U64(0x9E3779B97F4A7C15))
    return at, last, mix(total), (mix(more) >> U64(32)).astype(np.uint32)


def _later(post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrences, later occurrences, the first one of each of these) by digest; an occurrence listed twice is one."""
    post = post[np.lexsort((post["at"], post["hash"], post["doc"], post["more"], post["digest"]))]
    if not len(post):
        return post, post, post
    post = post[np.concatenate([[True], post[1:] != post[:-1]])]
    head = np.concatenate([[True], (post["digest"][1:] != post["digest"][:-1]) | (post["more"][1:] != post["more"][:-1])])
    first = post[head]
    return first, post[~head], first[(np.cumsum(head) - 1)[~head]]


def _marks(later: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """One row a document: its runs that repeat, as packed marks."""
    marks = np.empty(len(later), _MARK)
    marks["at"], marks["source"], marks["there"] = later["at"], _document(first["doc"], first["hash"]), first["at"]
    order = np.lexsort((later["at"], later["hash"], later["doc"]))
    marks, later = marks[order], later[order]
    key = later[["doc", "hash"]]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(later) else np.zeros(0, int)
    groups = np.split(marks, cut[1:]) if len(cut) else []
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(cut), pa.int32()), pa.nulls(len(cut), pa.binary()), pa.array(later["doc"][cut], pa.int64()), pa.array(later["hash"][cut], pa.int32()), pa.array([g.tobytes() for g in groups], pa.binary())],
        names=["part", "post", "k", "h", "at"],
    )


def spans(start: np.ndarray, end: np.ndarray, marks: np.ndarray, own: int, least: int) -> list[tuple[int, int]]:
    """Byte ranges of one document to delete, in order and apart; each is part of a stretch that stands at one earlier place.

    Marks of runs that overlap their first occurrence in the same document are left out.
    """
    marks = np.sort(np.unique(marks), order="at")
    out: list[tuple[int, int]] = []
    before, done = None, 0
    for at, source, there in marks.tolist():
        last = int(np.searchsorted(end, start[at] + least))
        if source == own and there + (last - at) >= at:
            continue
        z = int(end[last])
        if before == (at - 1, source, there - 1) and out:
            out[-1] = (out[-1][0], z)
        elif z > done:
            out.append((max(int(start[at]), done), z))
        before, done = (at, source, there), max(done, z)
    return out


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, least_run: int, chunking: Chunking = CHUNKS) -> DataFrame:
    """(k, h, ats): of each document with repeats the packed marks of runs that occur earlier in the corpus."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            first, later, source = _later(np.concatenate(held))
            held.clear()
            yield _marks(later, source)
            part = (first["digest"] % np.uint64(parts)).astype(np.int64)
            first, part = first[order := np.argsort(part, kind="stable")], part[order]
            names, at = np.unique(part, return_index=True)
            blobs = [x.tobytes() for x in np.split(first, at[1:])] if len(names) else []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.int32()), pa.nulls(len(names), pa.binary())], names=["part", "post", "k", "h", "at"])

        for batch in batches:
            ids, hashes = batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)
            for i, j, s in each_slice(batch[2]):
                start, end, doc = chunking.chunks(s)
                at, _, digest, more = runs(start, end, doc, s.hashes(start, end), least_run)
                of = doc[at]
                x = np.empty(len(at), _POST)
                x["digest"], x["more"], x["doc"], x["hash"] = digest, more, ids[i:j][of], hashes[i:j][of]
                x["at"] = at - np.searchsorted(doc, of)
                held.append(x)
                if sum(map(len, held)) >= _FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            marks = batch.filter(pa.compute.is_null(batch[0]))
            if marks.num_rows:
                yield marks
            for part, blob in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if part is None:
                    continue
                if part != now and held:
                    yield _marks(*_later(np.concatenate(held))[1:])
                    held = []
                now = part
                held.append(np.frombuffer(blob, _POST))
        if held:
            yield _marks(*_later(np.concatenate(held))[1:])

    import pyarrow.compute  # noqa: F401  for pa.compute on the executors

    schema = "part int, post binary, k long, h int, at binary"
    posts = _keyed(docs, id_col, text_col).select("k", "h", "text").mapInArrow(trimmed(post), schema)
    # marks travel to a partition by their document, posts by their bucket
    met = posts.repartition(shuffle_partitions(spark), F.coalesce("part", F.hash("k"))).sortWithinPartitions("part").mapInArrow(trimmed(meet), schema)
    return met.groupBy("k", "h").agg(F.collect_list("at").alias("ats"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("k"), F.hash(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_run: int = 64, chunking: Chunking = CHUNKS) -> DataFrame:
    """The rows of ``docs`` with repeated runs deleted from their texts, and a column ``removed_spans``.

    ``removed_spans`` lists what was deleted as (start, length) in code points of the old text; each span occurs whole at an earlier place.
    """
    marks = repeated_runs(docs, id_col, text_col, least_run, chunking)
    names = docs.columns
    packed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("k"), F.hash(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"), F.struct(*(F.col(f"`{c}`") for c in names if c != text_col)).alias("row"))
    joined = packed.join(marks.withColumnRenamed("k", "mk").withColumnRenamed("h", "mh"), (F.col("k") == F.col("mk")) & (F.col("h") == F.col("mh")), "left").select("row", "t", "ats", "k", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch[1].to_pylist(), [[] for _ in range(batch.num_rows)]
            marked = [i for i, x in enumerate(batch[2].to_pylist()) if x]
            own = _document(batch[3].to_numpy(zero_copy_only=False), batch[4].to_numpy(zero_copy_only=False)).tolist()
            ats = batch[2]
            sub = pa.array([texts[i] for i in marked], pa.large_string())
            for i, j, s in each_slice(sub):
                start, end, doc = chunking.chunks(s)
                base = np.searchsorted(doc, np.arange(s.n + 1))
                chars = s.chars_before()
                for k in range(j - i):
                    row = marked[i + k]
                    marks = np.frombuffer(b"".join(ats[row].as_py()), _MARK)
                    for p, q in spans(start[base[k] : base[k + 1]], end[base[k] : base[k + 1]], marks, own[row], least_run):
                        gone[row].append((int(chars[p] - chars[s.off[k]]), int(chars[q] - chars[p])))
            for i in marked:
                if gone[i]:
                    old, new, at = texts[i], [], 0
                    for p, n in gone[i]:
                        new.append(old[at:p])
                        at = p + n
                    texts[i] = "".join(new) + old[at:]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            out = [[{"start": p, "length": n} for p, n in x] for x in gone]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string()), pa.array(out, kind)], names=["row", "t", "removed_spans"])

    row = packed.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(trimmed(cut), f"row {row}, t string, removed_spans array<struct<start:long,length:long>>")
    kept = [F.col("t").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return done.select(*kept, "removed_spans")
