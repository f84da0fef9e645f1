"""Whole Arrow batches of text as flat byte buffers, with vectorised words, lines and hashes.

Every kernel here works on a *slice*: consecutive documents laid end to end in one ``uint8``
array with an offset array.  Slices hold about ``SLICE_BYTES`` bytes, so that the temporary
arrays (eight bytes a text byte, a handful of them) stay small whatever size the Arrow batch
has; a longer document is a slice of its own.  Null texts are empty ones.

Range hashes are polynomial: ``S[i] = sum(T[b_k] * P**k for k < i)`` modulo 2**64, so the hash of
any byte range is one subtraction and one multiplication, and every word, line or chunk of a
slice is hashed by a few NumPy calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)  # 5 modulo 8: its powers have the longest period
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_T = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: The six ASCII white-space characters: a word is a run of other bytes.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of P and of its inverse; tables over 4M entries are not kept."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for base in (_P, _PINV):
            a = np.full(size, base, U64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=U64))
        if size > 1 << 22:
            return both[0][:n], both[1][:n]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def flatten(col) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as (bytes, offsets)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + target, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Slice:
    """Documents ``i`` to ``j`` of a flattened column."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.off = off
        self.n = len(off) - 1
        self._sum: np.ndarray | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        n = len(self.buf)
        pw, inv = _pow(n + 1)
        if self._sum is None:
            self._sum = np.zeros(n + 1, U64)
            np.cumsum(_T[self.buf] * pw[:n], out=self._sum[1:])
        raw = (self._sum[end] - self._sum[start]) * inv[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the longest runs of True bytes that stay in one document."""
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:n]
        stop = np.zeros(n + 1, bool)
        stop[1:] = inside
        stop[1:n] &= ~inside[1:] | first[1:n]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop)
        return start, end, np.searchsorted(self.off, start, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the words ``[^\\x20\\x09-\\x0D]+``."""
        return self.runs(~SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the lines between ``\\n``, empty ones too."""
        cut = np.flatnonzero(self.buf == 10)
        start = np.concatenate([self.off[:-1], cut + 1])
        order = np.argsort(start, kind="stable")  # a document's start stands before a cut at the same place
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.off, cut, side="right") - 1])[order]
        start = start[order]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        end[last] = self.off[doc[last] + 1]
        return start, end, doc

    def chars_before(self) -> np.ndarray:
        """Code points before each byte place."""
        out = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]


def each_slice(col, lower: bool = False, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, Slice]]:
    buf, off = flatten(col)
    for i, j in slices(off, target):
        yield i, j, Slice(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower)


def order_by_doc(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order that sorts by document, then value; ties in any order.  Twice as fast as a two-key sort, and more."""
    first = np.argsort(values)
    d = doc[first]
    return first[np.argsort(d.astype(np.uint16) if len(d) and d.max() < 1 << 16 else d, kind="stable")]


def window_hashes(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive items of one document, and the index each window starts at."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[size - 1 :])
    out = h[at].copy()
    for k in range(1, size):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[at + k]
    return mix(out), at


def gear(buf: np.ndarray, table: np.ndarray, doublings: int) -> np.ndarray:
    """Gear hash over the last ``2**doublings`` bytes at each place, by doubling the window.

    ``h[i] = sum(table[b[i-j]] << j)``; the caller masks places nearer than a window to the start.
    """
    h = table[buf]
    for k in range(doublings):
        w = 1 << k
        up = h.copy()
        up[w:] += h[:-w] << np.uint32(w)
        h = up
    return h
