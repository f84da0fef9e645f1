"""Sequence packing: first-fit decreasing on a tournament tree, in randomised groups of documents.

Tokenising is a map over whole texts.  A document's ids (its tokens, then the separator) are cut
into pieces of at most one sequence.  Full pieces are sequences of their own and pass through the task they are dealt to one batch
at a time.  The remainders of a random group of about ``group_docs`` documents meet in one task and are packed there; a
group of more (rows that share id and text may do that) is packed ``MOST_HELD`` remainders at a time, so that is all a task holds.

* First-fit decreasing: the leaves of a tournament tree hold the free room of the open sequences,
  each inner node the larger of its two; one descent finds the leftmost sequence with room.
* What first-fit leaves open is topped up by cutting: the emptiest sequences are taken apart and
  fill gaps of at least ``min_cut`` ids elsewhere.  The last one is cut into sequences whose lengths
  are powers of two, which need no padding.

Contract: null text is empty text (one separator); an empty table gives an empty result; repeated
rows are packed each for itself; extra columns are ignored; a null id is packed like any other.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import pairs_of, shuffle_partitions, trimmed

#: Remainders that a task packs together.
MOST_HELD = 8192
PIECES = "part long, grp long, doc_id long, start long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Known(dict):
    """Parts to their ids; what is missing is encoded on first use."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        out = self[part] = self.encode(part)
        return out


class WordTokenizer:
    """A ``tokenizers`` file applied word part by word part, with a bounded memory of parts.

    Exact for files that split as ``word_bpe_49k.json`` does: white space is dropped, the rest falls
    into parts by a pattern, and each part is encoded for itself.  Latin-1 text is split here (its
    letters are composed and lower-case one to one); words with other characters are encoded by the
    library, white space apart; texts holding added tokens or U+001C to U+001F (white space to Python
    but not to the file), and all texts under another kind of file, are encoded whole.
    """

    #: The split pattern of the vocabulary file, and the same for lower-case Latin-1.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LATIN = "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \\t-\\r\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"

    def __init__(self, path: str, most_parts: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_part = names == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": self.PATTERN}
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *(x["content"] for x in spec.get("added_tokens", []))]
        self.parts = re.compile(self.LATIN)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.most = most_parts
        self.known = _Known(self._part)
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 onwards.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 0x100 + k for k, b in enumerate(others)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        if part[0] == "\x1c":  # marked by _split
            return self._whole(part[1:])
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))
        return np.array([t.id for t in tokens], self.dtype).tobytes()

    def _split(self, text: str) -> list[str] | None:
        if not self.by_part or any(x in text for x in self.odd):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            out: list[str] = []
            for w in text.split():
                out += self.parts.findall(w.lower()) if w.isascii() else ["\x1c" + w]  # marked: to be encoded by the library
            return out
        return self.parts.findall(text.lower())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        out: list[bytes] = []
        for t in texts:
            parts = self._split(t or "")
            out.append(self._whole(t) if parts is None else b"".join(map(self.known.__getitem__, parts)))
            if len(self.known) > self.most:  # common parts came first; the later half goes
                for part in list(itertools.islice(self.known, self.most // 2, None)):
                    del self.known[part]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Tournament:
    """Free room of up to ``n`` bins; ``place`` takes the leftmost bin with room."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        bin_, tree[i] = i - self.leaves, tree[i] - size
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a > b else b
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each item; items go in falling size, ties in the order given."""
    out = [0] * len(sizes)
    if sizes:
        bins = Tournament(len(sizes), room)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            out[i] = bins.place(sizes[i])
    return out


def pack_group(items: list[tuple], seq_len: int, min_cut: int) -> list[list[tuple]]:
    """Sequences of (doc_id, start, doc_tokens, ids) pieces; full items are sequences of their own."""
    bins = [[x] for x in items if len(x[3]) == seq_len]
    rest = [x for x in items if len(x[3]) < seq_len]
    where = first_fit_decreasing([len(x[3]) for x in rest], seq_len)
    open_: list[list[tuple]] = [[] for _ in range(max(where, default=-1) + 1)]
    for x, b in zip(rest, where, strict=True):
        open_[b].append(x)
    fill = lambda b: sum(len(x[3]) for x in b)
    open_ = sorted((b for b in open_ if b), key=fill, reverse=True)
    lo, bound = 0, len(open_) - 1
    room = [seq_len - fill(b) for b in open_]
    gaps = sorted((i for i in range(bound) if room[i] >= min_cut), key=lambda i: -room[i])
    donor = bound
    left = open_[donor] if open_ else []
    for lo in gaps:
        while room[lo] >= min_cut and lo < donor:
            if not left:
                donor -= 1
                if lo >= donor:
                    left = open_[donor]
                    break
                left = open_[donor]
                continue
            doc, start, total, ids = left.pop()
            take = min(room[lo], len(ids))
            open_[lo].append((doc, start, total, ids[:take]))
            room[lo] -= take
            if take < len(ids):
                left.append((doc, start + take, total, ids[take:]))
    if not open_:
        return bins
    bins += [b for b in open_[:donor] if b]
    last = [x for x in open_[donor] if len(x[3])]
    while last:
        size = fill(last)
        want = 1 << (size.bit_length() - 1)
        part: list[tuple] = []
        while want:
            doc, start, total, ids = last.pop(0)
            take = min(want, len(ids))
            part.append((doc, start, total, ids[:take]))
            want -= take
            if take < len(ids):
                last.insert(0, (doc, start + take, total, ids[take:]))
        bins.append(part)
    return bins


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: int = 1,
    seq_len: int = 2048,
    group_docs: int = 1024,
    min_cut: int = 8,
) -> DataFrame:
    """Pack every document; one row a piece, ``ids`` as unsigned little-endian 32-bit numbers."""
    spark = docs.sparkSession
    groups = max(1, docs.count() // group_docs)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end = np.array([separator], tok.dtype).tobytes()
        step, w = seq_len * tok.dtype.itemsize, tok.dtype.itemsize
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows: list[list] = [[] for _ in range(6)]
                for grp, doc, ids in zip(part[0].to_pylist(), part[1].to_pylist(), tok.encode(part[2].to_pylist()), strict=True):
                    ids += end
                    for a in range(0, len(ids), step):
                        full = a + step <= len(ids)  # dealt out by its own place, with no group
                        values = (grp + 1 + a // step, None, doc, a // w, len(ids) // w, ids[a : a + step]) if full else (grp, grp, doc, a // w, len(ids) // w, ids[a:])
                        for col, v in zip(rows, values, strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:5]), pa.array(rows[5], pa.binary())], names=["part", "grp", "doc_id", "start", "doc_tokens", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenizer(tokenizer_path).dtype
        here = TaskContext.get().partitionId()

        def rows(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def out(grp: int, first: int, items: list[tuple]) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(7)]
            k = first
            for k, seq in enumerate(pack_group(items, seq_len, min_cut), first + 1):
                at = 0
                for doc, start, total, ids in seq:
                    for col, v in zip(cols, (doc, start, len(ids), total, (grp << 32) + k, at, ids.astype("<u4").tobytes()), strict=True):
                        col.append(v)
                    at += len(ids)
            yield rows(cols)
            return k

        now, used, held, whole = None, 0, [], 0
        for batch in batches:
            single: list[list] = [[] for _ in range(7)]
            for grp, doc, start, total, ids in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if grp is None:
                    # full sequences are numbered above all groups, by task and place in it
                    whole += 1
                    for col, v in zip(single, (doc, start, seq_len, total, (1 << 62) + (here << 40) + whole, 0, np.frombuffer(ids, dtype).astype("<u4").tobytes()), strict=True):
                        col.append(v)
                    continue
                if grp != now or len(held) == MOST_HELD:
                    if held:
                        used = yield from out(now, used, held)
                    if grp != now:
                        used = 0
                    held = []
                now = grp
                held.append((doc, start, total, np.frombuffer(ids, dtype)))
            if single[0]:
                yield rows(single)
        if held:
            yield from out(now, used, held)

    # rows of one id but unlike texts are dealt apart
    grp = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "text"), F.lit(groups)).alias("grp")
    cut = pairs_of(docs, id_col, text_col).select(grp, "doc_id", "text").mapInArrow(trimmed(pieces), PIECES)
    return cut.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("grp", "doc_id", "start", "ids").mapInArrow(trimmed(packed), PACKED)
