"""Content-defined chunk boundaries by a gear rolling hash, for a whole slice of documents at once."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

from planewise.llm.textbuf import SPACE, Slice, gear

_GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, dtype=np.uint32)
DOUBLINGS = 4
#: Bytes that a boundary looks back on.
WINDOW = 1 << DOUBLINGS
#: Bytes after the last start of a word from which on code points can start a chunk.
REACH = 2 * WINDOW


def _peaks(s: Slice, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Flags of bytes that end a chunk far from any start of a word; ``word`` flags bytes before such a start.

    Peaks stand over WINDOW bytes apart but for ties, so each is taken whatever the boundary before.
    """
    n = len(h)
    place = np.arange(n + 1)
    last = np.zeros(n + 1, np.int64)
    last[1:][word] = place[1:][word]
    last[s.off[:-1]] = s.off[:-1]
    last = np.maximum.accumulate(last)
    far = place[1:] - last[1:] >= REACH
    if not far.any():
        return far
    # the first bytes of a document count as 0, so no window sees another document
    v = np.zeros(n + 2 * WINDOW, np.uint32)
    v[WINDOW : WINDOW + n] = h
    v[WINDOW : WINDOW + n - 1][s.buf[1:] & 0xC0 == 0x80] = 0
    for a, z in zip(s.off[:-1].tolist(), s.off[1:].tolist(), strict=True):
        v[WINDOW + a : WINDOW + min(a + WINDOW, z)] = 0
    most = v.copy()
    for k in range(DOUBLINGS):
        most[: -(1 << k)] = np.maximum(most[: -(1 << k)], most[1 << k :])
    here = v[WINDOW : WINDOW + n]
    top = np.maximum(most[:n], most[WINDOW + 1 : WINDOW + 1 + n])
    return far & (here > 0) & (here >= top)


@dataclass(frozen=True)
class Chunking:
    """Normalised chunking: a strict mask up to ``normal`` bytes, a loose one beyond, a cut at ``most``.

    The masks take the top bits of the hash, which depend on the whole window.  With ``at_words`` only
    the first byte of a word can start a chunk, and forced cuts fall between code points.  Where no word
    has started for ``REACH`` bytes (text without ASCII white space, long strings), a chunk also ends where the
    hash is the largest of a window on both sides, between code points.
    """

    least: int = WINDOW
    normal: int = 48
    most: int = 192
    strict_bits: int = 7
    loose_bits: int = 4
    at_words: bool = False

    def __post_init__(self) -> None:
        if self.least < WINDOW:
            raise ValueError("chunks must not be shorter than the window: their ends would depend on the document before")

    def ends(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ends, documents) of all chunks; a chunk starts where the last one ended.  Places depend on no byte outside the document."""
        h = gear(s.buf, _GEAR, DOUBLINGS)
        loose = (h >> np.uint32(32 - self.loose_bits)) == 0
        hard = h >> np.uint32(32 - self.strict_bits) == 0
        if self.at_words and len(loose):
            space = SPACE[s.buf]
            word = np.zeros(len(h), bool)
            word[:-1] = space[:-1] & ~space[1:]
            peak = _peaks(s, h, word)
            loose = loose & word | peak
            hard = hard & word | peak
        at = np.flatnonzero(loose)
        hard = hard[at]
        wide, tight = (at + 1).tolist(), (at[hard] + 1).tolist()
        ends: list[int] = []
        counts: list[int] = []
        buf = s.buf
        i = j = 0
        nw, nt = len(wide), len(tight)
        off = s.off.tolist()
        least, normal, most = self.least, self.normal, self.most
        for a, z in zip(off[:-1], off[1:], strict=True):
            had = len(ends)
            while z - a > least:
                j = bisect_left(tight, a + least, j)
                if j < nt and tight[j] < a + normal and tight[j] < z:
                    a = tight[j]
                else:
                    i = bisect_left(wide, a + normal, i)
                    end = a + most
                    if i < nw and wide[i] < end:
                        end = wide[i]
                    elif end < z:
                        while end > a + 1 and buf[end] & 0xC0 == 0x80:
                            end -= 1
                    if end >= z:
                        break
                    a = end
                ends.append(a)
            if z > a:
                ends.append(z)
            counts.append(len(ends) - had)
        return np.array(ends, np.int64), np.repeat(np.arange(s.n), counts)

    def chunks(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, documents)."""
        end, doc = self.ends(s)
        start = np.empty_like(end)
        start[1:] = end[:-1]
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        start[first] = s.off[doc[first]]
        return start, end, doc
