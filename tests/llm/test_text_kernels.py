"""The shared byte kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from planewise.llm.chunking import WINDOW, Chunking
from planewise.llm.docstats import BASE, base_stats
from planewise.llm.textbuf import each_slice, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.none() | st.text(alphabet="ab é漢\n\t\x1c\x85#|.A", max_size=60), max_size=8)


def _all(texts, lower=False, target=40):
    return list(each_slice(pa.array(texts, pa.string()), lower, target))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_lines(texts):
    words, lines = [], []
    for i, _, s in _all(texts):
        words += [(i + d, bytes(s.buf[a:z])) for a, z, d in zip(*s.words())]
        lines += [(i + d, bytes(s.buf[a:z])) for a, z, d in zip(*s.lines())]
    assert words == [(k, w.encode()) for k, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert lines == [(k, x.encode()) for k, t in enumerate(texts) for x in (t or "").split("\n")]


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_hashes_depend_on_content_only(texts):
    seen = {}
    for _, _, s in _all(texts):
        start, end, doc = s.words()
        h = s.hashes(start, end)
        g, at = window_hashes(h, doc, 2)
        for a, z, x in zip(start, end, h):
            assert seen.setdefault(bytes(s.buf[a:z]), x) == x
        for k, x in zip(at, g):
            pair = (bytes(s.buf[start[k] : end[k]]), bytes(s.buf[start[k + 1] : end[k + 1]]))
            assert seen.setdefault(pair, x) == x
    assert len({int(x) for x in seen.values()}) == len(seen)


def _brute(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cover = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab \n#é", max_size=80), max_size=6))
def test_base_counts(texts):
    got = np.concatenate([base_stats(s)[0] for _, _, s in _all(texts)] or [np.zeros((0, len(BASE)))])
    assert got.tolist() == [_brute(t or "") for t in texts]


def test_chunks_tile_and_resist_shifts():
    rng = np.random.default_rng(0)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(4000))
    for chunking in (Chunking(), Chunking(least=16, normal=20, most=160, strict_bits=2, loose_bits=1, at_words=True)):
        cuts = []
        for t in (text, "inserted in front, " + text):
            (_, _, s), = _all([t], target=1 << 30)
            start, end, _ = chunking.chunks(s)
            assert start[0] == 0 and end[-1] == len(t) and (start[1:] == end[:-1]).all()
            assert (end - start).max() <= chunking.most and (end - start)[:-1].min() >= min(chunking.least, WINDOW)
            cuts.append({t[a:z] for a, z in zip(start, end)})
        assert len(cuts[0] & cuts[1]) > 0.97 * len(cuts[0])


def test_chunks_do_not_depend_on_neighbours():
    texts = ["alpha beta gamma " * 40, "", "delta " * 100, "漢字" * 500]
    alone = [[e - s.off[0] for e in Chunking().ends(s)[0]] for t in texts for _, _, s in _all([t])]
    (_, _, s), = _all(texts, target=1 << 30)
    end, doc = Chunking().ends(s)
    assert [list(end[doc == k] - s.off[k]) for k in range(len(texts))] == alone


def test_chunks_resist_shifts_without_white_space():
    rng = np.random.default_rng(1)
    at_words = Chunking(least=16, normal=20, most=160, strict_bits=2, loose_bits=1, at_words=True)
    han = lambda n: "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, n))
    thai = lambda n: "".join(chr(c) for c in rng.integers(0x0E01, 0x0E2F, n))
    base64 = lambda n: "".join(chr(c) for c in rng.integers(0x41, 0x5B, n))
    spaced = lambda gap: lambda n: gap.join(base64(5) for _ in range(n // 6))
    for make in (han, thai, base64, spaced("\u00a0"), spaced("\u3000")):
        passage = make(400)
        size = len(passage.encode())
        for before in (1, 7, 50, 333):
            texts = [make(200) + passage + make(90), make(200 + before) + passage + make(30)]
            cuts, (_, _, s) = [], next(iter(_all(texts, target=1 << 30)))
            start, end, doc = at_words.chunks(s)
            for k, t in enumerate(texts):
                a = int(s.off[k]) + len(t[: t.index(passage)].encode())
                own = (doc == k) & (start >= a) & (end <= a + size)
                cuts.append(set(zip((start[own] - a).tolist(), (end[own] - a).tolist())))
                (_, _, alone), = _all([t], target=1 << 30)
                assert (at_words.ends(alone)[0] == end[doc == k] - s.off[k]).all()
            assert sum(z - a for a, z in cuts[0] & cuts[1]) > 0.7 * size
            for z in end[:-1].tolist():
                assert s.buf[z] & 0xC0 != 0x80
