"""The ten operators on small tables: odd rows, brute force, round trips."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from planewise.llm import components, fingerprint, html_text, langid, ngram_join, packing, quality, rules, sharding, spm, substring

TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, k int, grp int"


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "re", "mi", "on", "es", "la", "du", "ki"]
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


ODD = [
    (1, _prose(1, 80)), (2, None), (3, ""), (4, "  \n\t "), (5, _prose(1, 80)), (6, "one"), (7, "one two three"), (None, _prose(2, 40)),
    (None, None), (8, "Ünïcode 漢字 ▁ <|endoftext|> don't x\x1cy"), (9, _prose(3, 3000)), (9, _prose(3, 3000)), (-4, _prose(1, 80) + " extra"), (10, "a" * 5000),
]


def _docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "xx", "s", None, 0.0, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


# -- 1: fingerprints --------------------------------------------------------------------------


def test_fingerprints(docs, none):
    got = fingerprint.compare_edited(docs).collect()
    texts = sorted(((-(1 << 63) if i is None else i), t or "") for i, t in ODD)
    expect = Counter()
    for (i, a), (_, b) in zip(texts, texts[1:] + texts[:1]):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        expect[(None if i == -(1 << 63) else i, len(a), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expect
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[5].fingerprint != by_id[9].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compare_edited(none).count() == 0


def test_containment():
    text = _prose(5, 400)
    a, b, c, empty = fingerprint.fingerprints([text, text[:200] + " new words " + text[200:], _prose(6, 400), ""])
    assert fingerprint.containment(a, a) == 1 and fingerprint.containment(a, c) < 0.05
    assert fingerprint.containment(a, b) > 0.8
    assert fingerprint.containment(empty, empty) == 1 and fingerprint.containment(empty, a) == 0 == fingerprint.containment(a, empty)
    assert (fingerprint.from_string(fingerprint.to_string(a)) == a).all()


def test_one_document(spark):
    r, = fingerprint.compare_edited(_docs(spark, [(7, "abcd")])).collect()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())


# -- 2: packing ---------------------------------------------------------------------------------


def _check_packed(rows, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    ids = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in docs)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())))
        assert r.length == len(r.ids) // 4 > 0
    for (i, text), n in ids.items():
        mine = sorted(pieces[(i, len(text))])
        whole = [x for _, p in mine for x in p]
        assert sorted(whole) == sorted(list(text) * n)  # repeated rows interleave
        if n == 1:
            assert whole == list(text) and all(a + len(p) == b for (a, p), (b, _) in zip(mine, mine[1:]))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048


def test_packing(docs, none):
    rows = packing.pack_documents(docs, TOKENS).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in ODD}
    _check_packed(rows, ODD)
    assert packing.pack_documents(none, TOKENS).count() == 0


def test_packing_of_hot_rows_and_giants(spark, monkeypatch):
    """A group larger than a task may hold is packed in parts; full pieces belong to no group."""
    monkeypatch.setattr(packing, "MOST_HELD", 16)
    rows = [(1, _prose(8, 9000)), (None, "a b c")] * 2 + [(7, "same words in every row")] * 100 + [(100 + i, _prose(i, 30)) for i in range(50)]
    got = packing.pack_documents(_docs(spark, rows), TOKENS, group_docs=10_000).collect()
    _check_packed(got, rows)
    assert sum(r.length == 2048 and r.offset == 0 for r in got) >= 2 * (max(r.doc_tokens for r in got) // 2048)


def test_first_fit_decreasing_is_leftmost():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 101, 300).tolist()
    got = packing.first_fit_decreasing(sizes, 100)
    room, expect = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [100] * (b == len(room))
        room[b] -= sizes[i]
        expect[i] = b
    assert got == [expect[i] for i in range(len(sizes))]


def test_pack_group_keeps_every_id_and_pads_little():
    rng = np.random.default_rng(4)
    items = [(d, 0, int(n), rng.integers(0, 9, n)) for d, n in enumerate(rng.integers(1, 2049, 400))]
    bins = packing.pack_group(items, 2048, 8)
    back = {}
    for b in bins:
        assert sum(len(x[3]) for x in b) <= 2048
        for doc, start, _, ids in b:
            back.setdefault(doc, {})[start] = ids
    assert all((np.concatenate([v for _, v in sorted(back[d].items())]) == ids).all() for d, _, _, ids in items)
    sizes = [sum(len(x[3]) for x in b) for b in bins]
    assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.005 * sum(sizes)
    assert packing.pack_group([], 2048, 8) == []


def test_word_tokenizer_is_exact():
    t = packing.WordTokenizer(TOKENS, most_parts=20)  # memory is dropped again and again
    texts = [x or "" for _, x in ODD] + ["'s's ''t I'LL", "ΣΑΣ İ é ½²", "a　b\xa0c\x85d", "<|startoftext|>", "x'reé"]
    assert [np.frombuffer(b, t.dtype).tolist() for b in t.encode(texts)] == [t.tok.encode(x, add_special_tokens=False).ids for x in texts]


# -- 3: n-gram join -------------------------------------------------------------------------------


def _brute_components(rows, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in names.items()}
    return Counter((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def _got_components(df, **kw):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.component_table(df, **kw).collect())


def test_ngram_join_odd_rows(docs, none):
    assert _got_components(docs) == _brute_components(ODD, 4, 85)
    assert ngram_join.component_table(none).count() == 0


@pytest.mark.parametrize(("size", "percent", "hot"), [(4, 85, 1 << 20), (5, 80, 1 << 20), (4, 85, 2)])
def test_ngram_join_near_copies(spark, monkeypatch, size, percent, hot):
    """Families whose members differ by few or many words: links, chains of links, and pairs just below the limit; also with nearly all keys dealt out."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = np.random.default_rng(size)
    rows, common = [], _prose(99, 60).split()
    for family in range(6):
        base = _prose(100 + family, 120).split()
        for _ in range(25):
            w = list(base)
            for p in rng.integers(0, len(w), rng.integers(0, 7)):
                w[p] = f"w{rng.integers(1000)}"
            w = w[: len(w) - rng.integers(0, 12)]
            if rng.random() < 0.4:
                w += common
            rows.append((len(rows) * 3, " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:20])]
    expect = _brute_components(rows, size, percent)
    assert 6 < len({c for _, _, c in expect}) < len(rows)
    assert _got_components(_docs(spark, rows), size=size, percent=percent) == expect


def test_components_of_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    for block in (components._LOCAL_EDGES, 50):
        monkeypatch.setattr(components, "_LOCAL_EDGES", block)
        got = {r.u: r.v for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: root(x) for x in parent if root(x) != x}


# -- 4 and 10: classifiers --------------------------------------------------------------------------


def _labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = _prose(i, 40 + i % 90)
        rows.append((i, text if good else text.upper().replace(" ", "!! ") + " ### $$$ %%%"))
        labels.append((i, int(good), 0))
    return _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, none):
    table, labels = _labelled(spark)
    model = quality.train(table, labels)
    got = {r.doc_id: r for r in quality.score_documents(table, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    odd = quality.score_documents(docs, model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (2, 3)}) == 1
    assert quality.score_documents(none, model).count() == 0
    kept = quality.keep_good(table, model)
    assert kept.schema == table.schema and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}
    alone = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.score_documents(docs, alone).collect()} == {0.5}


def test_held_out_labels_are_not_learned(spark):
    table, labels = _labelled(spark, 120)
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(table, x) for x in (labels, other))
    assert np.array_equal(a.means, b.means) and a.slope == b.slope


def test_rules(spark, docs, none):
    table, labels = _labelled(spark)
    model = rules.train(table, labels)
    got = {r.doc_id: r for r in rules.apply_rules(table, model).collect()}
    assert np.mean([got[i].kept == (i % 4 != 0) for i in got if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.9
    odd = {(r.doc_id, r.n_words): r for r in rules.apply_rules(docs, model).collect()}
    assert odd[(2, 0)].base_failed and not odd[(2, 0)].kept and odd[(10, 1)].base_failed
    assert rules.apply_rules(none, model).count() == 0
    assert not rules.train(docs, labels.where("false")).feature.size


def test_trees_are_monotonic_and_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(rules.NAMES)))
    k = rules.NAMES.index("symbol_share")
    y = (x[:, k] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.normal(size=600) < 0.6).astype(float)
    model = rules.fit(x, y, trees=30)
    grid = np.repeat(x[:20], 50, axis=0)
    grid[:, k] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(model.margin(grid).reshape(20, 50), axis=1) <= 1e-12).all()
    for row, margin in zip(x[:50], model.margin(x[:50])):
        total = model.bias
        for f, t, left, v in zip(model.feature, model.threshold, model.left, model.value):
            at = 0
            while f[at] >= 0:
                at = left[at] + int(row[f[at]] > t[at])
            total += v[at]
        assert abs(total - margin) < 1e-9
    assert ((model.score(x) > 0.5) == y).mean() > 0.85


# -- 5: html ------------------------------------------------------------------------------------


def test_html_scan():
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body><header>H</header><nav><ul><li><a href="/">M</a></li></ul></nav>'
        '<article><h1>Head &amp; line</h1><p>One <b>two</b>three<br>four &lt;x&gt; &nbsp;y<p>Five<div class="share">Share</div><section id="comments"><p>Nice</p></section></article>'
        '<aside>A</aside><div class="ad">Buy</div><footer>F</footer></bod'
    )
    blocks, _ = html_text.scan(page)
    assert [b for b in blocks if b] == ["Head & line", "One twothree four <x> y", "Five"]
    assert [b for b in html_text.scan("a < b <!-- no --> c<p>d")[0] if b] == ["a < b c", "d"]
    assert html_text.scan("") == ([], []) and html_text.scan("<script>x")[0] == []


def test_html_templates(spark):
    page = lambda i: f"<body><div><span>Site</span> of all</div><div><p>Own text {i}</p><p>Quoted by all</p></div><ul><li>Home</li><li>About</li></ul></body>"
    rows = [(i, f"https://user@a.example:80/p{i}?x", page(i)) for i in range(5)] + [(90, "https://b.example/", page(90)), (91, None, page(91)), (92, "https://b.example/e", None), (None, "x", ""), (90, "https://b.example/", page(90))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, k int")
    got = {}
    for r in html_text.extract_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Own text 3\nQuoted by all"]  # a paragraph needs more pages than a container
    whole = "Site of all\nOwn text 90\nQuoted by all\nHome\nAbout"
    assert got[90] == [whole, whole] and got[91] == [whole.replace("90", "91")]
    assert got[92] == [""] and got[None] == [""]
    assert html_text.extract_text(df.where("false")).count() == 0


def _texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract_text(df).collect()}


def test_html_class_words_keep_article_text():
    kept = ['<p class="ad-hoc">one</p>', '<div class="share-price">two</div>', '<section class="social-science"><p>three</p></section>', '<p id="notice-period">four</p>', '<div class="related"><p>five</p></div>']
    gone = ['<div class="ad"><p>x</p></div>', '<section id="comments"><p>y</p></section>', "<aside>z</aside>"]
    blocks, _ = html_text.scan("<article>" + "".join(kept) + "".join(gone) + "</article>")
    assert [b for b in blocks if b] == ["one", "two", "three", "four", "five"]
    outside = ['<div class="site-footer">x</div>', '<div class="comments-list">y</div>', '<ul class="top-menu"><li>z</li></ul>', '<div id="cookie-notice">w</div>', '<div class="header">v</div>']
    blocks, _ = html_text.scan("<body>" + "".join(kept[:4]) + "".join(outside) + "</body>")
    assert [b for b in blocks if b] == ["one", "two", "three", "four"]
    blocks, _ = html_text.scan("<main><p>The long text of the page itself.</p><article>card</article><article>card</article></main>")
    assert [b for b in blocks if b] == ["The long text of the page itself.", "card", "card"]


@pytest.mark.parametrize("article", [False, True])
def test_html_recurrence_by_brute_force(spark, article):
    """Unnamed parts go by how many unlike pages of their host have them, and by nothing else."""
    rng = np.random.default_rng(9)
    lines = [f"line {k} {_prose(k, 6)}" for k in range(30)]
    pages = []
    for i in range(120):
        some = [lines[k] for k in rng.permutation(30) if rng.random() < (k + 1) / 60]
        own = [_prose(10_000 + i * 5 + j, 12) for j in range(3)]
        pages.append((f"http://h{i % 2}.org/{i}", [str(x) for x in rng.permutation([*some, *own])]))
    pages += [(url + "?print", blocks) for url, blocks in pages[:30]]  # copies count once
    html = lambda blocks: ("<article>{}</article>" if article else "<body>{}</body>").format("".join(f"<div><p>{b}</p></div>" for b in blocks))
    got = spark.createDataFrame([(i, url, html(blocks)) for i, (url, blocks) in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in html_text.extract_text(got).collect()}
    contents = {h: {tuple(b) for u, b in pages if u.startswith(f"http://{h}")} for h in ("h0.org", "h1.org")}
    for i, (url, blocks) in enumerate(pages):
        host = contents[url.split("/")[2]]
        often = {b: sum(b in c for c in host) for b in blocks}
        stay = [b for b in blocks if often[b] < max(3, 0.005 * len(host))]
        assert got[i].text == "\n".join(stay) and got[i].removed == len(blocks) - len(stay)
    assert any(r.removed for r in got.values()) and any(f"line {k} " in r.text for r in got.values() for k in range(30))


def test_html_copies_of_a_page_are_one(spark):
    plain = "<body><div><h1>Head</h1><p>Told once</p></div></body>"
    article = "<body><article><div class=body><h1>Head</h1><p>Told in an article</p></div></article>{}</body>"
    rows = [(i, f"https://a.example/?ref={i}", plain) for i in range(4)] + [(10 + i, f"https://b.example/?ref={i}", article.format(f"<footer>No {i}</footer>")) for i in range(4)]
    got = _texts(spark, rows)
    assert all(got[i] == "Head\nTold once" for i in range(4))
    assert all(got[10 + i] == "Head\nTold in an article" for i in range(4))


def test_html_shares_of_a_large_host(spark):
    table = "<table><tr><td>Shared by a few</td></tr></table>"
    page = lambda i: f"<body><p>Own text {i}</p>{table if i < 4 else ''}{'<p>Said by some</p>' if i < 12 else ''}<ul><li>Site menu</li></ul></body>"
    got = _texts(spark, [(i, f"https://a.example/{i}", page(i)) for i in range(1000)])
    assert got[0] == "Own text 0\nShared by a few\nSaid by some" and got[11] == "Own text 11\nSaid by some"
    assert all(got[i] == f"Own text {i}" for i in range(12, 1000))


def test_html_recurrence_inside_the_article(spark):
    def page(i):
        own = [f"<p>Own text {i} {k}</p>" for k in range(4 + i % 5)]
        if i % 4 == 0:
            own.insert(i // 4 % len(own), "<p>Quoted by a quarter</p>")
        if i % 2:
            own.insert(i // 2 % len(own), "<p>An advert</p>")
        return f"<body><article><h1>Title {i}</h1>{''.join(own)}{'<ul><li>Subscribe now</li></ul>' if i % 10 == 3 else ''}</article></body>"

    got = _texts(spark, [(i, f"https://a.example/{i}", page(i)) for i in range(200)])
    for i, text in got.items():
        assert text.startswith(f"Title {i}\n") and all(f"Own text {i} {k}" in text for k in range(4 + i % 5))
        assert ("Quoted by a quarter" in text) == (i % 4 == 0)
        assert "Subscribe" not in text and "advert" not in text


def test_html_last_paragraph_of_many_articles(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1>{''.join(f'<p>Own {i} {k}</p>' for k in range(2 + i % 4))}{'<p>Read more here</p>' if i % 10 == 3 else ''}</article></body>"
    got = _texts(spark, [(i, f"https://a.example/{i}", page(i)) for i in range(200)])
    assert all(got[i] == "\n".join([f"Title {i}", *(f"Own {i} {k}" for k in range(2 + i % 4))]) for i in range(200))


# -- 6: language -------------------------------------------------------------------------------


def _speech(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "heit"]}[lang]
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


def test_language(spark, docs, none):
    rows = [(i, _speech("ab"[i % 2] * 2, i), "ab"[i % 2] * 2, "s", 1) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    models = langid.train(table, most_docs=60)
    got = {r.doc_id: r for r in langid.identify(table, models).collect()}
    assert models.langs == ["aa", "bb"] and all(got[i].lang_pred == "ab"[i % 2] * 2 and got[i].accepted for i in got)
    odd = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 ### 4"), (4, "zqx wvp yjq " * 40), (None, _speech("aa", 999))], "doc_id long, text string"), models).collect()
    assert [(r.lang_pred, r.accepted) for r in odd[:3]] == [("und", False)] * 3 and odd[0].score == 0
    assert odd[3].lang_pred in models.langs and not odd[3].accepted and odd[4].lang_pred == "aa"
    rng = np.random.default_rng(1)
    junk = ["".join(rng.choice(list("bcdfghjqvwxz "), 300)) for _ in range(20)] + ["Это совсем другой язык и другие буквы " * 5, "x9 " * 60, "la lune est belle ce soir et nous marchons " * 6]
    fresh = [_speech("ab"[i % 2] * 2, 5000 + i, 3 + i) for i in range(80)]
    judged = {r.doc_id: r.accepted for r in langid.identify(_docs(spark, list(enumerate(junk + fresh))), models).collect()}
    assert not any(judged[i] for i in range(len(junk))) and sum(judged[len(junk) + i] for i in range(80)) >= 78
    kept = langid.keep_known(table, models)
    assert kept.schema == table.schema and kept.count() == 200
    assert langid.identify(none, models).count() == 0
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_kneser_ney_sums_to_one(spark):
    """Under every seen context the letters' probabilities sum to one."""
    table = spark.createDataFrame([(i, _speech("aa", i, 30), "aa") for i in range(12)], "doc_id long, text string, lang string")
    m = langid.train(table, folds=1, held_out=9)
    letters = sorted({ord(c) for i in range(12) for c in _speech("aa", i, 30) if c != " "} | {0})
    for context in ([0], [0, ord("k")], [ord("k"), ord("a")], [0, ord("k"), ord("a")]):
        total = 0.0
        for c in letters:
            sign = np.array([0, *context, c] if context[0] else [*context, c], np.uint32)
            g, ctx = langid.grams(sign, np.zeros(len(sign), np.int64))
            total += float(np.exp(m.logp([x[-1:] for x in g], [x[-1:] for x in ctx]))[0, 0])
        # one share of the uniform floor belongs to unseen letters
        assert 0.97 < total <= 1.0001


# -- 7: substrings ------------------------------------------------------------------------------


def test_substrings(spark, none):
    passage = _prose(500, 70)
    rows = [(1, _prose(1, 100) + " " + passage + " " + _prose(2, 50)), (2, _prose(3, 37) + "\n" + passage + "\n" + _prose(4, 90)), (3, _prose(5, 60)), (4, None), (5, ""), (None, "short"), (6, passage + "."), (3, _prose(5, 60)), (7, "漢" * 3000)]
    done = substring.dedup_substrings(_docs(spark, rows))
    assert done.columns[:9] == _docs(spark, []).columns
    got = {}
    for r in done.collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {k: [r.text for r in v] for k, v in got.items()}
    assert texts[1] == [rows[0][1]] and texts[3] == [rows[2][1]] * 2 and texts[4] == [None] and texts[5] == [""] and texts[None] == ["short"]
    middle = passage[len(passage) // 3 : -len(passage) // 3]
    assert middle in texts[1][0] and middle not in texts[2][0] and middle not in texts[6][0]
    assert _prose(3, 37)[:150] in texts[2][0] and _prose(4, 90)[60:] in texts[2][0]
    for r in (got[2][0], got[6][0], got[7][0]):
        old, new, at = dict((k, t) for k, t in rows if k)[r.doc_id], "", 0
        for s in r.removed_spans:
            assert s.length > 0 and s.start >= at
            new += old[at : s.start]
            at = s.start + s.length
        assert new + old[at:] == r.text
    assert substring.dedup_substrings(none).count() == 0


def test_removed_spans_occur_earlier(spark, sf_dir):
    """Brute force: every span stands whole in an earlier document or before itself; phrases seen apart do not add up."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(100_000 + k, " ".join(_prose(900 + 20 * k + j, 6) for j in range(12))) for k in range(3)]
    parts = [_prose(900 + 20 * (k % 3) + j, 6) for k, j in enumerate(range(9))]  # each of another document
    rows += [(200_000, " ".join(p + " " + _prose(7000 + k, 2) for k, p in enumerate(parts))), (200_001, "again and again " * 60)]
    texts = dict(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for least in (64, 150):
        found = [r for r in substring.dedup_substrings(table, least_run=least).collect() if r.removed_spans]
        assert found
        for r in found:
            old = texts[r.doc_id]
            for s in r.removed_spans:
                span = old[s.start : s.start + s.length]
                assert any(span in t for i, t in rows if i < r.doc_id) or span in old[: s.start + s.length - 1], (r.doc_id, span)
    got = {r.doc_id: r for r in substring.dedup_substrings(table).collect()}
    assert got[200_000].removed_spans == [] and got[100_001].removed_spans == []
    assert 60 < len(got[200_001].text) < 400


def test_substrings_without_white_space(spark):
    rng = np.random.default_rng(5)
    han = lambda n: "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, n))
    passage = han(400)
    rows = [(1, han(100) + passage + han(60)), (2, han(137) + passage + han(90)), (3, han(300))]
    got = {r.doc_id: r for r in substring.dedup_substrings(_docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert passage[60:-60] not in got[2].text and sum(n for _, n in got[2].removed_spans) > 340
    assert got[2].text.startswith(rows[1][1][:137]) and got[2].text.endswith(rows[1][1][-90:])


# -- 8: sentencepiece ----------------------------------------------------------------------------


def _library(texts):
    import sentencepiece

    return [np.array(x, "<u4").tobytes() for x in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)]


def test_sentencepiece_round_trip(docs, none):
    for chunk in (1 << 16, 50, 3):  # the smaller ones make giants of most texts
        coded = spm.encode_documents(docs, PIECES, chunk=chunk)
        back = spm.decode_documents(coded, PIECES).collect()
        assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, t or "") for i, t in ODD)
        plain = [r for r in back if "▁" not in r.decoded]  # the library takes the sign for a space
        assert [bytes(r.ids) for r in plain] == _library([r.decoded for r in plain])
        compared = spm.encode_documents(docs, PIECES, chunk=chunk, compare=True).collect()
        assert Counter((r.doc_id, bytes(r.ids), r.chunks, r.exact) for r in compared) == Counter((r.doc_id, bytes(r.ids), r.chunks, True) for r in back)
    assert spm.encode_documents(none, PIECES).count() == 0


def test_ids_are_the_library_s(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    for chunk in (1 << 16, 97):
        got = {r.doc_id: bytes(r.ids) for r in spm.encode_documents(spark.createDataFrame(rows), PIECES, chunk=chunk).collect()}
        assert [got[r.doc_id] for r in rows] == _library([r.text for r in rows])


SIGNS = [_prose(1, 40), "x" * 200, "  two  spaces ", "".join(np.random.default_rng(0).choice(list("abc é漢"), 300)), "thequickbrownfox" * 15, "日本語のテキスト" * 25, " " * 90 + "x" + " " * 77, "\n\na\n \n b" * 9, "1234567890" * 12]


@pytest.mark.parametrize("chunk", [1, 2, 5, 16, 33, 90])
def test_max_plus_scan_gives_the_library_s_ids(chunk):
    v = spm.vocabulary(PIECES)
    for text, ids in zip(SIGNS, _library(SIGNS), strict=True):
        s = v.signs(text)
        parts = []
        for a in range(0, len(s), chunk):
            lo, z = max(0, a - v.longest), min(len(s), a + chunk)
            parts.append((s[lo : z + v.longest], a - lo, z - lo, z == len(s)))
        matrices = [v.matrix(*p) for p in parts]
        whole = matrices[0]
        for m in matrices[1:]:
            whole = spm.combine(whole, m)
        assert whole.tolist() == [[len(ids) // 4]]  # the weight of the best path is its number of ids
        states = spm.best_states(matrices)
        half = len(matrices) // 2
        if half:  # associative: two products, then the states of either half
            left, right = (spm.reduce(spm.combine, m) for m in (matrices[:half], matrices[half:]))
            middle = spm.best_states([left, right])[1]
            assert spm.best_states(matrices[:half], 0, middle) + spm.best_states(matrices[half:], middle, 0)[1:] == states
        out = [v.trace(*p, a, z) for p, a, z in zip(parts, states, states[1:])]
        assert b"".join(x for x, _ in out) == ids and "".join(x for _, x in out) == s


def test_merging_is_the_library_s():
    v = spm.vocabulary(PIECES)
    for text, ids in zip(SIGNS, _library(SIGNS), strict=True):
        assert b"".join(map(v.spell, v.merged(v.signs(text)))) == ids


# -- 9: sharding --------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 30, 20_000, 3_000, 200])
def test_sharding(spark, docs, none, limit):
    rows = [(i, _prose(i, 5 + i % 40)) for i in range(300)] + [r for r in ODD if r[0] is None] + [(7777, _prose(k, 30)) for k in range(60)]
    got = sharding.shard_documents(_docs(spark, rows), limit=limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard_id, []).append(r)
    for name, rs in shards.items():
        assert {(r.shard_bytes, r.shard_rows) for r in rs} == {(sum(r.n_bytes for r in rs), len(rs))}
        assert rs[0].oversize == (rs[0].shard_bytes > limit)
        assert not rs[0].oversize or len(rs) == 1
    first = [s for s in shards if "." not in s]
    assert not any(a != b and b.startswith(a) for a in first for b in first)

    def place(key):
        return f"{int(hashlib.md5((chr(0) + 'null' if key is None else str(key)).encode()).hexdigest()[:15], 16):060b}"

    sizes = Counter()
    for i, t in rows:
        for d in range(61):
            sizes[place(i)[:d]] += len((t or "").encode())
    for r in got:
        if "." not in r.shard_id and not r.oversize:
            p = place(r.doc_id)
            assert r.shard_id == next(p[:d] for d in range(61) if sizes[p[:d]] <= limit)
    assert sharding.shard_documents(none, limit=limit).count() == 0
