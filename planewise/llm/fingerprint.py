"""Document fingerprints from content-defined chunks.

A text is cut by a normalised gear hash; its fingerprint is the set of its chunks' 64-bit digests,
each weighted by the chunk's length.  The likeness of A to B is the share of A's weight whose digests
B has as well (containment): 1 for equal texts, near 0 for unrelated ones, and an insertion changes
only the chunks around it, wherever it shifts the rest to.

Contract: null text is empty text; an empty text has the empty fingerprint, fully contained in an
empty one and not at all in another; equal texts have equal fingerprints.  Null ids come first in the
order of documents, equal ids are ordered by text; a repeated row is a document of its own; texts are
read whole; extra columns are ignored.  An empty table gives an empty result.  Documents are dealt to tasks by ranges of ids, so rows
of one id (or without one) meet in one task, one batch at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planewise.llm.chunking import Chunking
from planewise.llm.common import pairs_of, shuffle_partitions, trimmed
from planewise.llm.textbuf import each_slice, order_by_doc

CHUNKS = Chunking()
_ENTRY = np.dtype([("digest", "<u8"), ("weight", "<u2")])
_FIRST = -(1 << 63)


def fingerprints(texts: list[str | None], chunking: Chunking = CHUNKS) -> list[np.ndarray]:
    """Of each text the sorted (digest, weight) entries."""
    out: list[np.ndarray] = []
    for _, _, s in each_slice(pa.array(texts, pa.large_string())):
        start, end, doc = chunking.chunks(s)
        digest = s.hashes(start, end)
        order = order_by_doc(digest, doc)
        digest, doc, weight = digest[order], doc[order], (end - start)[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
        entries = np.empty(int(new.sum()), _ENTRY)
        entries["digest"], entries["weight"] = digest[new], weight[new]
        out += np.split(entries, np.searchsorted(doc[new], np.arange(1, s.n)))
    return out


def to_string(entries: np.ndarray) -> str:
    return base64.b64encode(entries.tobytes()).decode("ascii")


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _ENTRY)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The weighted share of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    have = set(b["digest"].tolist())
    digests, weights = a["digest"].tolist(), a["weight"].tolist()
    return sum(w for d, w in zip(digests, weights, strict=True) if d in have) / sum(weights)


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of a text column."""
    return pd.Series([to_string(x) for x in fingerprints(text.tolist())], dtype=object)


@F.pandas_udf(T.DoubleType())
def contained(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of fingerprint ``a`` is in ``b``."""
    return pd.Series([containment(from_string(x), from_string(y)) for x, y in zip(a, b, strict=True)], dtype=float)


def with_neighbour(docs: DataFrame, id_col: str, text_col: str, schema: str, kernel) -> DataFrame:
    """Stream ``kernel(rows)`` over (doc_id, text) pairs that overlap by one: each document and the next by id, cyclically.

    One shuffle of the texts: ranges of ids, bounded by ids that occur, are dealt to tasks and sorted
    there, and the first document of each range is sent to the range before it as well.
    """
    spark = docs.sparkSession
    rows = pairs_of(docs, id_col, text_col).select("doc_id", "text", F.coalesce("doc_id", F.lit(_FIRST)).alias("k"))
    ranges = min(20_000, 4 * shuffle_partitions(spark))
    cut = [i / ranges for i in range(1, ranges)]
    stat = rows.agg(F.min("k").alias("least"), F.percentile_approx("k", cut, 10 * ranges).alias("cuts")).first()
    least = stat["least"] if stat["least"] is not None else 0
    bounds = np.array(sorted({x for x in stat["cuts"] or [] if x > least}), np.int64)
    heads = np.concatenate([[least], bounds]).astype(np.int64)

    @F.pandas_udf("struct<own:long,before:long>")
    def ranged(k: pd.Series) -> pd.DataFrame:
        own = np.searchsorted(bounds, k.to_numpy(), side="right")
        before = np.where(heads[own] == k.to_numpy(), (own - 1) % len(heads), -1)
        return pd.DataFrame({"own": own, "before": before})

    # a row goes to its own range and, as the first of it, to the end of the range before
    at = F.explode(F.filter(F.array(F.struct(F.col("r.own").alias("rng"), F.lit(False).alias("extra")), F.struct(F.col("r.before").alias("rng"), F.lit(True).alias("extra"))), lambda x: x["rng"] >= 0))
    dealt = rows.withColumn("r", ranged("k")).select("doc_id", "text", "k", at.alias("at")).select("at.rng", "at.extra", "k", "doc_id", "text")
    dealt = dealt.repartition(min(ranges, shuffle_partitions(spark)), "rng").sortWithinPartitions("rng", "extra", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, done, size = None, False, 0
        for batch in batches:
            rng, extra, _, ids, text = batch.columns
            for r, x, i, t in zip(rng.to_pylist(), extra.to_pylist(), ids.to_pylist(), text.to_pylist(), strict=True):
                if r != now:
                    now, done, size, held = r, False, 0, []
                if done:
                    continue
                held.append((i, t or ""))
                size += len(held[-1][1])
                done = x
                if done or size > 1 << 20:
                    if len(held) > 1:
                        yield kernel(held)
                    held = held[-1:]
                    size = len(held[0][1])

    return dealt.mapInArrow(trimmed(run), schema)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    edited = []
    for (_, a), (_, b) in zip(rows[:-1], rows[1:], strict=True):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    own, other = fingerprints([t for _, t in rows]), fingerprints(edited)
    n = len(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows[:n]], pa.int64()),
            pa.array([len(t) for _, t in rows[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([to_string(x) for x in own[:n]]),
            pa.array([to_string(x) for x in other]),
            pa.array([containment(own[k], other[k]) for k in range(n)], pa.float64()),
            pa.array([containment(own[k], own[k + 1]) for k in range(n)], pa.float64()),
        ],
        names=[x.split()[0] for x in COMPARED.split(", ")],
    )


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last half is the start of the next document."""
    return with_neighbour(docs, id_col, text_col, COMPARED, _compare)
