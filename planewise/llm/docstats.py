"""Document statistics, computed for a slice of whole texts at once; inputs of the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import fold, trimmed
from planewise.llm.textbuf import Slice, each_slice, flatten, order_by_doc, slices, window_hashes

SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0x80)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_STOP = np.isin(np.arange(256), list(b".!?"))
_COMMA = np.isin(np.arange(256), list(b",;:"))
REPEAT_WINDOW = 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model inputs; the shares are in 0..1.
NAMES = [
    "log_words", "word_length", "upper_share", "symbol_share", "exclaim_share", "digit_share", "comma_share", "stop_share", "odd_share",
    "doubled_share", "distinct_share", "repeat_share", "dup_line_share", "log_line_words", "bare_share", "short_share", "long_share", "top_share", "capital_share",
]


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each document in 8-word windows that it has twice or more."""
    g, at = window_hashes(h, doc, REPEAT_WINDOW)
    if not len(g):
        return np.zeros(n, np.int64)
    order = order_by_doc(g, doc[at])
    sg, sd = g[order], doc[at][order]
    same = (sg[1:] == sg[:-1]) & (sd[1:] == sd[:-1])
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    places = at[order[twice]]
    np.add.at(cover, places, 1)
    np.add.at(cover, places + REPEAT_WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def _dup_lines(s: Slice, words_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them that equal an earlier line) of each document."""
    start, end, doc = s.lines()
    full = words_before[end] > words_before[start]
    start, end, doc = start[full], end[full], doc[full]
    h = s.hashes(start, end)
    order = order_by_doc(h, doc)
    h, d = h[order], doc[order]
    later = d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]
    return np.bincount(doc, minlength=s.n), np.bincount(later, minlength=s.n)


def base_stats(s: Slice, full: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The five counts of each document (columns ``BASE``) and, if ``full``, the model inputs (``NAMES``)."""
    n, buf = s.n, s.buf
    start, end, doc = s.words()
    h = s.hashes(start, end)
    chars = s.chars_before()
    begun = np.zeros(len(buf) + 1, np.int64)
    begun[start + 1] = 1
    begun = np.cumsum(begun)  # words begun before each place
    length = chars[end] - chars[start]
    words = np.bincount(doc, minlength=n)
    word_chars = np.bincount(doc, weights=length, minlength=n).astype(np.int64)
    symbols = s.per_doc(SYMBOL[buf])
    lines, dup = _dup_lines(s, begun)
    repeated = _repeats(h, doc, n)
    counts = np.stack([words, word_chars, symbols, dup, repeated], axis=1)
    if not full:
        return counts, None
    w, c = np.maximum(words, 1), np.maximum(word_chars, 1)
    letters = np.maximum(s.per_doc(_LETTER[buf]), 1)
    of_words = lambda flags: np.bincount(doc[flags], minlength=n) / w
    order = order_by_doc(h, doc)
    sh, sd = h[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(sh)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, sd[at], runs)
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    has_letter = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf] | _DIGIT[buf], out=has_letter[1:])
    odd = (buf < 0x80) & ~_LETTER[buf] & ~_DIGIT[buf] & (buf > 32) & ~_STOP[buf] & ~_COMMA[buf]
    x = np.stack(
        [
            np.log1p(words), word_chars / w, s.per_doc(_UPPER[buf]) / letters, symbols / c, s.per_doc(buf == 33) / c, s.per_doc(_DIGIT[buf]) / c,
            s.per_doc(_COMMA[buf]) / c, s.per_doc(_STOP[buf]) / c, s.per_doc(odd) / c, of_words(doubled), np.bincount(sd[at], minlength=n) / w, repeated / w,
            dup / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)), of_words(has_letter[end] == has_letter[start]), of_words(length <= 3), of_words(length >= 16),
            top / w, of_words(_UPPER[buf[start]] if len(buf) else np.zeros(0, bool)),
        ],
        axis=1,
    )
    return counts, x


def scored(docs: DataFrame, id_col: str, text_col: str, schema: str, kernel, extra: list | None = None) -> DataFrame:
    """``kernel(ids, counts, inputs) -> columns`` over every slice of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for i, j, s in each_slice(batch[1]):
                counts, x = base_stats(s, True)
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rest[0], *kernel(counts, x), *rest.columns[2:]], names=names)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(extra or [])]
    return docs.select(*cols).mapInArrow(trimmed(run), schema)


def kept_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of ``docs`` whose texts pass ``keep(counts, inputs) -> bool array``; a map, no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = flatten(batch[place])
            mask = [keep(*base_stats(Slice(buf[off[i] : off[j]], off[i : j + 1] - off[i]), True)) for i, j in slices(off)]
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(trimmed(run), docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5, held_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Model inputs and labels of at most ``most`` labelled documents outside the held-out fold.

    The sample is the ``most`` ids of the smallest hash.  Rows without an id or label are left out; an id
    labelled twice counts with the larger label, as does one with two texts (each a row; ``most``
    bounds ids, and rows come back ``most`` at the most).
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .where(fold("doc_id", folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    schema = "doc_id long, " + ", ".join(f"x{k} double" for k in range(len(NAMES))) + ", y double"
    table = scored(rows, "doc_id", "text", schema, lambda counts, x: [pa.array(c) for c in x.T], [F.col("y")])
    got = table.orderBy(F.xxhash64("doc_id"), *table.columns).limit(most).toPandas().to_numpy(dtype=float)
    return got[:, 1:-1], got[:, -1]
