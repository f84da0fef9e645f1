"""Operators that SQL cannot express, against plain versions written from their definitions."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from planewise.llm import chunking, fingerprint, langid, quality, substring

WORD_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def _rows(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


# -- 1: fingerprints ------------------------------------------------------------------------------


def _plain_chunks(text: str) -> list[bytes]:
    """The normalised gear rule, byte by byte."""
    b, rule = text.encode(), fingerprint.CHUNKS
    table = chunking._GEAR.tolist()
    h = [sum(table[b[i - j]] << j for j in range(min(chunking.WINDOW, i + 1))) & 0xFFFFFFFF for i in range(len(b))]
    out, a = [], 0
    while len(b) - a > rule.least:
        end = next((e for e in range(a + rule.least, min(a + rule.normal, len(b))) if h[e - 1] >> (32 - rule.strict_bits) == 0), None)
        if end is None:
            end = next((e for e in range(a + rule.normal, min(a + rule.most, len(b))) if h[e - 1] >> (32 - rule.loose_bits) == 0), None)
        if end is None:
            end = a + rule.most
            if end >= len(b):
                break
            while b[end] & 0xC0 == 0x80:
                end -= 1
        out.append(b[a:end])
        a = end
    return out + [b[a:]] * (a < len(b))


def _plain_likeness(a: str, b: str) -> float:
    x, y = set(_plain_chunks(a)), set(_plain_chunks(b))
    if not x:
        return float(not y)
    return sum(len(c) for c in x & y) / sum(len(c) for c in x)


def test_fingerprints_by_brute_force(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    got = {r.doc_id: r for r in fingerprint.compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 2
        edited = text[: len(text) - n] + after[:n]
        assert got[i].near_next == pytest.approx(_plain_likeness(text, after), abs=1e-9)
        assert got[i].near_edited == pytest.approx(_plain_likeness(text, edited), abs=1e-9)
        assert len(fingerprint.from_string(got[i].fingerprint)) == len(set(_plain_chunks(text)))


# -- 4: quality ------------------------------------------------------------------------------------


def test_discriminant_by_brute_force():
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.6).astype(float)
    x = np.abs(rng.normal(size=(300, 19)) + y[:, None] * rng.normal(size=19))
    model = quality.fit(x, y, pool=0.1, ridge=0.05)
    t = quality.transform(x)
    z = (t - t.mean(axis=0)) / (t.std(axis=0) + 1e-6)
    covs = []
    for k in (0, 1):
        p = z[y == k] - z[y == k].mean(axis=0)
        covs.append(sum(np.outer(r, r) for r in p) / len(p))
    pooled = sum(c * (y == k).sum() for k, c in enumerate(covs)) / len(y)
    ridge = np.trace(pooled) / 19 * np.eye(19)
    logs = []
    for k in (0, 1):
        c = 0.85 * covs[k] + 0.1 * pooled + 0.05 * ridge + 1e-9 * np.eye(19)
        r = z - z[y == k].mean(axis=0)
        logs.append(np.array([-0.5 * (v @ np.linalg.inv(c) @ v + np.linalg.slogdet(c)[1]) for v in r]))
    assert np.allclose(model.difference(x), logs[1] - logs[0], rtol=1e-6, atol=1e-6)
    score = model.score(x)
    order = np.argsort(logs[1] - logs[0])
    assert (np.diff(score[order]) >= -1e-12).all() and score.min() >= 0 and score.max() <= 1


# -- 6: language -------------------------------------------------------------------------------------


def _signs(text: str) -> list[str]:
    """Lower-case letters, and one boundary sign (empty) before the text and around words."""
    out = [""]
    for ch in text:
        letter = (ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalpha() else ""
        if letter or out[-1]:
            out.append(letter)
    return out


def _grams(text: str):
    """(n-grams of orders 1 to ORDER) of every sign but the first; a boundary is repeated, never crossed."""
    signs = _signs(text)
    for i in range(1, len(signs)):
        back, gram, grams = i, (signs[i],), []
        for k in range(langid.ORDER):
            grams.append(gram)
            back -= back > 0 and (k == 0 or gram[0] != "")
            gram = (signs[back] if k == 0 or gram[0] != "" else "",) + gram
        yield grams


def _plain_model(texts: list[str], vocabulary: int):
    counts = [Counter() for _ in range(langid.ORDER)]
    for t in texts:
        for grams in _grams(t):
            for k, g in enumerate(grams):
                counts[k][g] += 1
    for k in range(langid.ORDER - 1):  # lower orders count the signs that go before
        counts[k] = Counter(g[1:] for g in counts[k + 1]) | Counter({g: 1 for g in counts[k]})
    total, kinds, discount = [], [], []
    for c in counts:
        t, d = defaultdict(int), defaultdict(int)
        for g, n in c.items():
            t[g[:-1]] += n
            d[g[:-1]] += 1
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        total.append(t)
        kinds.append(d)
        discount.append(min(0.9, max(0.1, once / max(once + 2 * twice, 1) if once + twice else 0.5)))

    def p(grams, k):
        if k < 0:
            return 1 / vocabulary
        g, lower = grams[k], p(grams, k - 1)
        t = total[k].get(g[:-1], 0)
        if not t:
            return lower
        return max(counts[k].get(g, 0) - discount[k], 0) / t + discount[k] * kinds[k][g[:-1]] / t * lower

    return lambda text: -np.mean([np.log(p(g, langid.ORDER - 1)) for g in _grams(text)])


def test_kneser_ney_by_brute_force(spark):
    rng = np.random.default_rng(6)
    syllables = {"aa": ["ka", "lo", "mi", "ta", "ön"], "bb": ["sch", "ung", "ein", "heit", "lo"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))
    rows = [(i, say("ab"[i % 2] * 2, 12) + (", 5 " if i % 3 else ""), "ab"[i % 2] * 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(table)
    learned = defaultdict(list)
    for r in langid.training_docs(table, langid.MOST_DOCS, 4, 2).where("not calibrates").collect():
        learned[r.lang].append(r.text)
    letters = {g[0] for texts in learned.values() for t in texts for g in ([x[0][0]] for x in _grams(t))}
    plain = {lang: _plain_model(texts, len(letters) + 1) for lang, texts in learned.items()}
    fresh = [say("aa", 9), say("bb", 7), "zq wx ÿ", rows[3][1], "lo"]
    from planewise.llm.textbuf import flatten
    import pyarrow as pa

    got, _, _ = models.entropies(*flatten(pa.array(fresh)))
    for text, h in zip(fresh, got, strict=True):
        assert [plain[name](text) for name in models.langs] == pytest.approx(h.tolist(), abs=2e-4)


# -- the pipeline -----------------------------------------------------------------------------------


def _components(rows, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in "".join(" " if c in WORD_CHARS else c for c in t.translate(low)).split(" ") if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = root[b], root[a]
                root = [new if r == old else r for r in root]
    return root


def test_pipeline_by_brute_force(spark, sf_dir):
    """Each stage on its predecessor's rows: models as tested above, pairs one by one, spans in the texts, ids from the tokenizer."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    one = stage["language"](spark, docs, sf_dir)
    accepted = {r.doc_id for r in langid.identify(docs, langid.train(docs)).where("accepted").collect()}
    assert rows(one) == [r for r in rows(docs) if r[0] in accepted]
    two = stage["quality"](spark, one, sf_dir)
    model = quality.train(one, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score_documents(one, model).where("predicted = 1").collect()}
    assert rows(two) == [r for r in rows(one) if r[0] in good]
    three = stage["near_duplicates"](spark, two, sf_dir)
    given = rows(two)
    root = _components(given, 5, 80)
    assert rows(three) == [r for k, r in enumerate(given) if root.index(root[k]) == k]
    four = stage["repeated_passages"](spark, three, sf_dir)
    given, left = dict(rows(three)), []
    for r in substring.dedup_substrings(three).collect():
        text, at = "", 0
        for s in r.removed_spans:
            span = given[r.doc_id][s.start : s.start + s.length]
            assert any(span in t for i, t in given.items() if i < r.doc_id) or span in given[r.doc_id][: s.start + s.length - 1]
            text, at = text + given[r.doc_id][at : s.start], s.start + s.length
        left.append((r.doc_id, text + given[r.doc_id][at:]))
    assert rows(four) == sorted(left)
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    import zlib

    assert set(pieces) == set(dict(left))
    for i, text in left:
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and zlib.crc32(ids[start : start + n].tobytes()) == crc
            at += n
        assert at == len(ids)
