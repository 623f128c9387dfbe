"""The operators that run Python in their tasks, against brute force, round trips and held-out accuracy."""

import collections
import re

import numpy as np
import pytest
from samples import ODD, prose
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import gbt, html_extract, licenses, lm_scoring, near_dedup, quality_classifier, queries, toxicity
from tessera.llm.components import connected_components

quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# Near-duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), k) if x is not None], default=None)
    return [(len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def variants(seed, n, edits):
    import random

    rng, base, out = random.Random(seed), prose(seed, 150).split(), []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_brute_force(docs):
    texts = [*ODD, *variants(1, 40, 6), *variants(2, 25, 2), *[prose(3)] * 6, prose(3).upper(), prose(4), prose(4) + " tail", "a b c", "A  b\tc", "a b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(rows, extra=True)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_components(rows)


@pytest.mark.parametrize("rows,stars", [(7, False), (5, True), (128, False)])
def test_near_duplicates_in_blocks(docs, monkeypatch, rows, stars):
    texts = variants(5, 60, 5) + variants(6, 30, 3) + [prose(40 + i) for i in range(5)]
    given_rows = list(enumerate(texts))
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    if not stars:
        # Without the links to hubs, blocks must find everything.
        monkeypatch.setattr(near_dedup, "_star_links", lambda pairs, sets, percent: pairs.limit(0))
        texts, given_rows = texts[:60], given_rows[:60]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(given_rows)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(given_rows)


def test_connected_members_of_a_block_are_not_compared():
    sets = [near_dedup.shingle_set(t) for t in variants(5, 12, 3)]
    sketches, sides = np.stack([near_dedup.registers(s) for s in sets]), np.zeros(12, int)
    assert list(near_dedup.block_links(sets, sketches, sides, 85, ["c"] * 12)) == []
    links = list(near_dedup.block_links(sets, sketches, sides, 50, ["c"] * 6 + ["d"] * 6))
    assert len(links) == 1 and links[0][0] < 6 <= links[0][1]


def test_chained_texts_cost_what_they_share(docs, monkeypatch):
    """Each text shares half with the next: one cluster of different texts, in which nothing is compared but neighbours."""
    moved = []
    real = near_dedup.materialise

    def written(df):
        out = real(df)
        moved.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialise", written)
    totals = []
    for n in (100, 400):
        moved.clear()
        texts = [" ".join(prose(100 + i + k, 60) for k in range(4)) for i in range(n)]
        rows = near_dedup.near_duplicates(docs(texts)).collect()
        assert all(r.kept for r in rows)
        totals.append(sum(moved))
    assert totals[1] < 4.6 * totals[0], totals


def test_recall_at_the_threshold():
    rng = np.random.RandomState(8)
    for percent, low, high in ((85, 0.85, 0.90), (80, 0.80, 0.85)):
        bands, rows = near_dedup.banding(percent)
        met = passed = 0
        for _ in range(300):
            j, n = rng.uniform(low, high), rng.randint(60, 600)
            union = rng.randint(0, 2**62, int(n / j) + 1).astype(np.uint64)
            own = (len(union) - n) // 2
            a, b = np.unique(union[: n + own]), np.unique(np.concatenate((union[:n], union[n + own :])))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = near_dedup.registers(a), near_dedup.registers(b)
            same = (x == y)[: bands * rows].reshape(bands, rows).all(axis=1).any()
            met += same
            passed += same and near_dedup.likely(np.array([(x == y).sum()]), np.array([(x > y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]), min(j, percent / 100))[0]
        assert (met, passed) == (300, 300)


@pytest.mark.parametrize("percent,want", [(85, (25, 5)), (80, (31, 4)), (99, (15, 8))])
def test_bands(percent, want):
    assert near_dedup.banding(percent) == want


def test_near_duplicates_odd_ids(docs):
    rows = [(5, prose(1)), (5, prose(1)), (5, prose(2)), (None, prose(1)), (2, prose(2)), (None, prose(9)), (7, None), (7, "")]
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("5", "5"), ("5", "5"), ("5", "2"), ("None", "5"), ("2", "2"), ("None", "None"), ("7", "7"), ("7", "7")])
    assert near_dedup.near_duplicates(docs([])).count() == 0


def test_deduplication_keeps_one_of_each_group(docs):
    rows = [(3, prose(1)), (1, prose(1).upper()), (2, prose(2)), (2, prose(2)), (4, ""), (6, None), (8, variants(3, 1, 0)[0]), (9, variants(3, 1, 0)[0] + " end")]
    df = docs(rows, extra=True)
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 6, 8]
    named = df.withColumns({"__id": F.lit("keep me"), "__key": F.lit("and me"), "text_key": F.lit(3), "kept": F.lit(False)})
    out = near_dedup.deduplicate(named)
    assert out.columns == named.columns and {(r["__id"], r["__key"], r["kept"]) for r in out.collect()} == {("keep me", "and me", False)}


def test_registers_merge_and_estimate():
    rng = np.random.RandomState(1)
    pool = rng.randint(0, 2**62, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (np.maximum(ra, rb) == near_dedup.registers(np.unique(pool))).all()
    share = (ra == rb).mean()
    assert abs(share - 1 / 3) < 0.15
    n = np.array([2000.0])
    assert not near_dedup.likely(np.array([int((ra == rb).sum())]), np.array([int((ra > rb).sum())]), n, n, 0.85)[0]
    same = near_dedup.registers(np.unique(pool[:1900]))
    assert near_dedup.likely(np.array([int((ra == same).sum())]), np.array([int((ra > same).sum())]), n, np.array([1900.0]), 0.85)[0]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aAbZé \n\t\x0b\x85日"), max_size=40))
def test_word_hashes_tell_words_apart(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = near_dedup.word_hashes(text).tolist()
    assert len(hashes) == len(words) and len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
    assert len(near_dedup.shingle_set(text)) == len(shingles(text))


@quick
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, edges):
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u != v:
                m = min(root[u], root[v])
                changed |= root[u] != m or root[v] != m
                root[u] = root[v] = m
    assert got == root


def test_components_of_a_path_and_a_star(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.label for r in connected_components(path).collect()} == {0}
    star = spark.createDataFrame([(500, i) for i in range(500)], "u long, v long")
    assert {r.label for r in connected_components(star).collect()} == {0}


# Trees


def test_trees_learn_and_match_plain_traversal():
    rng = np.random.RandomState(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    f = gbt.fit(x[:1000], y[:1000])
    assert ((f.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9
    for row in x[:20]:
        total = f.base
        for t in range(len(f.feature)):
            k = 0
            while k < 2**f.depth - 1:
                k = 2 * k + 1 + int(row[f.feature[t, k]] > f.threshold[t, k])
            total += f.leaf[t, k - (2**f.depth - 1)]
        assert abs(total - f.margin(row[None])[0]) < 1e-9


def test_trees_without_signal():
    for y in (np.zeros(50), np.ones(50), np.zeros(0)):
        f = gbt.fit(np.zeros((len(y), 3)), y)
        assert 0 <= f.probability(np.zeros((2, 3)))[0] <= 1


def test_isotonic_rises_and_fits():
    rng = np.random.RandomState(2)
    m = rng.normal(size=2000)
    y = (rng.random_sample(2000) < 1 / (1 + np.exp(-3 * m))).astype(float)
    c = gbt.isotonic(m, y)
    at = np.linspace(-3, 3, 50)
    assert (np.diff(c(at)) > 0).all()
    assert np.abs(c(at) - 1 / (1 + np.exp(-3 * at))).mean() < 0.06
    assert 0 <= gbt.isotonic(np.zeros(0), np.zeros(0))(np.zeros(1))[0] <= 1


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


INSULT = "you are an idiot and a worthless stupid clown "


@pytest.fixture(scope="module")
def corpus(spark):
    texts, rows = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 5 == 0
        t = ("WORD!! ### " * (20 + i % 9)) if bad else prose(i, 60 + i % 40)
        w = t.split()
        if rude:
            w[7:7] = INSULT.split()
        texts.append(" ".join(w))
        rows.append((i, int(not bad), int(rude)))
    return texts, rows


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers(spark, docs, corpus, which):
    import zlib

    texts, rows = corpus
    score, modulus, rest, at = (quality_classifier.quality_scores, 3, 1, 1) if which == "quality" else (toxicity.toxicity_scores, 5, 0, 2)
    everything = [*texts, *ODD]
    out = {r.doc_id: r for r in score(docs(everything, extra=True), labels(spark, [*rows, (None, 1, 1), (9999, 0, 1)])).collect()}
    assert len(out) == len(everything)
    for r in out.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    unseen = [(out[r[0]].predicted, r[at]) for r in rows if out[r[0]].held_out]
    assert sum(a == b for a, b in unseen) / len(unseen) > 0.95
    # What a row is called has no bearing on its score, and held-out labels aren't learnt from.
    turned = [(i, 1 - q, 1 - t) if out[i].held_out else (i, q, t) for i, q, t in rows]
    again = {r.doc_id: r.score for r in score(docs(everything).withColumn("lang", F.lit("xx")), labels(spark, turned)).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-12 for i in out)


@pytest.mark.parametrize("score", [quality_classifier.quality_scores, toxicity.toxicity_scores])
def test_classifiers_without_labels(spark, docs, score):
    assert score(docs([]), labels(spark, []).limit(0)).count() == 0
    assert {0 <= r.score <= 1 for r in score(docs(ODD), labels(spark, []).limit(0)).collect()} == {True}
    one = score(docs(["a", "a", None]), labels(spark, [(0, 1, 1)]))
    assert one.select("score").distinct().count() == 1


def test_good_documents(spark, docs, corpus):
    texts, rows = corpus
    df = docs(texts, extra=True)
    out = quality_classifier.good_documents(df, labels(spark, rows))
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert {i for i, q, _ in rows if q} == kept


def test_toxic_features_see_through_disguise():
    f = toxicity.make_features({"blorg*": 4.0})
    plain, strong, near, found = 0, 2, 8, 18
    assert f("you absolute idiot")[plain] == 1 and f("you absolute idiot")[near] == 1
    assert f("such 1d10t talk")[found] == 1 and f("i.d.i.o.t")[found] == 1 and f("id1ooooot")[found] == 1
    assert f("blorgen blorgs other")[strong] == 2 and f("blor other")[strong] == 0
    assert all(np.isfinite(f(t)).all() for t in ODD)


# Licenses


def test_license_base_places(docs):
    texts = [*ODD, "The MIT License, the mit-license; MIT  licenses", "Licensed under the Apache License, Version 2.0", "GNU Lesser General Public License v3 and general public license", "mit license mit license", "license mit", "GENERAL\nPUBLIC\tLICENSE"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in licenses.scan(docs(texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert list(r.base_labels) == sorted({x for _, x in places}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert licenses.scan(docs([])).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: ISC", {"isc"}),
        ("licensed under the Apache License", {"apache"}),
        ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License", {"gpl-2.0"}),
        ("the GNU General Public License, version 3", {"gpl-3.0"}),
        ("under the 2-Clause BSD or the BSD-3-Clause", {"bsd-2-clause", "bsd-3-clause"}),
        ("Neither the name of the Foo nor the names of its contributors may be used to endorse or promote products", {"bsd-3-clause"}),
        ("Apache License,\n Version 1.1", {"apache-1.1"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
        ("under the terms of the GNU Lesser General Public License", {"lgpl"}),
        ("licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("GNU Affero General Public License version 3", {"agpl-3.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
        ("Redistribution and use in source and binary forms, with or without modification", {"bsd"}),
        ("see https://creativecommons.org/licenses/by-sa/4.0/ for details", {"cc-by-sa-4.0"}),
        ('"license": "MIT"', {"mit"}),
        ("Copyright (c) 2019-2021 Someone", {"copyright"}),
        ("mit freundlichen Grüßen, der Apache flog", set()),
        ("nothing of the kind here", set()),
    ],
)
def test_license_rules(text, want):
    spans = licenses.Scanner().detect(text.lower())
    assert {r.label for _, _, r in spans} == want
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.integers(0, 5)), max_size=12))
def test_suppression(spans):
    found = [(a, a + n, licenses.Rule(str(p), "name", re.compile("x"), 0.5, p)) for a, n, p in spans]
    out = licenses.suppress(found)
    assert all(x[1] <= y[0] for x, y in zip(out, out[1:], strict=False)) and bool(out) == bool(found)
    for x in found:
        # What went lies inside another detection or overlaps one that stands.
        assert x in out or any(y[0] < x[1] and x[0] < y[1] for y in out) or any(y is not x and y[0] <= x[0] and x[1] <= y[1] for y in found)


def test_license_rules_are_gated_and_many():
    rules, words = licenses.build_rules()
    assert len(rules) > 360 and len(licenses.SIGNATURES) > 100
    assert len({r.label for r in rules if r.kind == "signature"}) > 70
    reached = {r for at in words.values() for r in at}
    assert reached == set(range(len(rules)))


# Page text


WEIGHTS = html_extract.fit(np.zeros((0, html_extract.FEATURES)), np.zeros(0))


def text_of(page):
    return html_extract.extract(page, WEIGHTS)


ARTICLE = "<article><h1>A &amp; B</h1><p>First <b>bold</b>\n text,&nbsp;here.<p>Second &lt;p&gt; one.</p><ul><li>x<li>y</ul></article>"


def test_article_alone_is_kept():
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div>{ARTICLE}<aside>Side</aside><section id=comments><p>Nice article, thanks a lot!</p></section><form><label>Mail</label><input></form><div class=ad>Buy</div><script>var x='<p>no</p>';</script><footer>&copy; 2020</footer></body></html>"
    assert text_of(page) == "A & B\n\nFirst bold text, here.\n\nSecond <p> one.\n\nx\n\ny"


def test_notices_inside_the_article_go():
    page = "<article><h1>Title</h1><div class='share-buttons'>Share this</div><p>Body text.</p><aside>Aside</aside><div class='advert'>Ad</div><!-- c --><noscript>no</noscript></article>"
    assert text_of(page) == "Title\n\nBody text."


def test_pages_without_landmarks():
    long = "This is a long paragraph of the story, with commas, stops and a good many words in it, as stories have."
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=4>More</a></div></body>"
    assert text_of(page) == f"{long}\n\nShort.\n\n{long}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<br>", "\x00", "<article>", "&amp;", "<p>&#x41;&bogus;&#0;</p>", "<div>" * 3000, "<b>" * 2000 + "x"])
def test_broken_pages(page):
    assert isinstance(text_of(page), str)


def test_minimum_cut_brute_force():
    rng = np.random.RandomState(3)
    for _ in range(60):
        n = int(rng.randint(1, 7))
        source, sink = rng.randint(0, 9, n).astype(float).tolist(), rng.randint(0, 9, n).astype(float).tolist()
        edges = [(i, j, float(rng.randint(0, 5))) for i in range(n) for j in range(i + 1, n) if rng.rand() < 0.6]

        def cost(side, source=source, sink=sink, edges=edges):
            return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for u, v, c in edges if side[u] != side[v])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_extract.min_cut(source, sink, edges)) - best) < 1e-9


def test_extraction_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_html_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>", "\0", body.replace("<br>", " ")))
        import html

        want = [x for x in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in body.split("\0")) if x]
        assert r.text == "\n\n".join(want) and r.n_chars == len(r.text)


def test_extraction_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, ARTICLE, "y")], "page_id long, url string, html string, text string")
    rows = html_extract.extract_pages(df).collect()
    assert sorted(r.n_chars for r in rows)[:2] == [0, 0] and len(rows) == 3
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# Language model


def test_windows_at_the_edges():
    e = 99
    c = lm_scoring.windows(np.array([1, 2, 3, 4, 5, 6], np.int16), np.array([0, 3, 5, 5, 6]), e)
    assert c.T.tolist() == [[e, e, 2, 3], [e, 1, 3, e], [1, 2, e, e], [e, e, 5, e], [e, 4, e, e], [e, e, e, e]]
    assert lm_scoring.windows(np.zeros(0, np.int16), np.zeros(2, np.int64)).shape == (4, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .-\u00e9\u65e5", max_size=12)), max_size=6), st.integers(0, 2))
def test_hashed_words_are_the_words(texts, skip):
    import pyarrow as pa

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = [word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts[skip:]]
    hashes, ends = lm_scoring.hashed_words(pa.array(texts, pa.string())[skip:])
    assert np.diff(ends, prepend=0).tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["Alpha beta", "gamma " * 50 + "alpha", "beta"])
    whole = lm_scoring.hashed_words(texts)
    monkeypatch.setattr(lm_scoring, "_STRETCH", 16)
    cut = lm_scoring.hashed_words(texts)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist() == [2, 53, 54]
    assert whole[0][0] == whole[0][-2] and whole[0][1] == whole[0][-1]


def plain_score(texts):
    """Scores by loops over strings: counts, softmax over all classes and slots, share; with the operator's own weights."""
    import pyarrow as pa

    def run(known, network, counts, text):
        words, _ = lm_scoring.hashed_words(pa.array([text]))
        leaf = known.leaves(words)[0].astype(int).tolist()
        mass = collections.Counter()
        for w, n in counts.items():
            mass[int(known.leaves(np.array([w], np.uint64))[0][0])] += n
        total = 0.0
        for i, w in enumerate(words.tolist()):
            around = [leaf[j] if 0 <= j < len(leaf) else lm_scoring.EDGE * lm_scoring.SLOTS for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(sum(network.leaf[k][x].astype(float) for k, x in enumerate(around)) + network.bias)
            by_class = np.exp(h @ network.out + network.out_bias)
            c, s = divmod(leaf[i], lm_scoring.SLOTS)
            by_slot = np.exp(h @ network.fine[c] + network.fine_bias[c])
            total += np.log(by_class[c] / by_class.sum()) + np.log(by_slot[s] / by_slot.sum()) + np.log(counts[w] / mass[leaf[i]])
        return total

    return run


def test_scores_by_loops(spark, docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "KNOWN", 20)
    texts = [prose(i, 30) for i in range(12)]
    df = docs(texts)
    known, counted = lm_scoring.corpus_vocabulary(df)
    network = lm_scoring.train(df, known)
    words = collections.Counter(w for t in texts for w in lm_scoring.hashed_words(pa.array([t]))[0].tolist())
    assert {r.word % 2**64: r.n for r in counted.collect()} == words and len(known.keys) == 20
    got = {r.doc_id: r for r in lm_scoring.score(df).collect()}
    brute = plain_score(texts)
    for i in (0, 5, 11):
        assert got[i].log_likelihood == pytest.approx(brute(known, network, words, texts[i]), rel=1e-4)
        own = collections.Counter(lm_scoring.hashed_words(pa.array([texts[i]]))[0].tolist())
        rare = [w for w in own.elements() if w not in known.keys]
        assert (got[i].n_rare, got[i].n_rare_elsewhere) == (len(rare), sum(words[w] > own[w] for w in rare))


def test_probabilities_sum_to_one(docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "KNOWN", 20)
    df = docs([prose(i, 30) for i in range(12)])
    known, counts = lm_scoring.corpus_vocabulary(df)
    rows = counts.toPandas()
    leaf, share, rare = known.leaves(rows["word"].to_numpy(np.int64).view(np.uint64))
    share = share + np.where(rare, np.log(rows["n"].to_numpy()), 0)
    net = lm_scoring.train(df, known)
    context = np.repeat(leaf[:4, None], len(leaf), axis=1)
    assert np.exp(net.log_likelihoods(context, leaf) + share).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_matches_differences():
    rng, c = np.random.RandomState(6), lm_scoring.CLASSES
    net = lm_scoring.Network.start(np.full(c, 1 / c))
    net.fine += rng.normal(0, 0.3, net.fine.shape).astype(np.float32)
    context, leaf = rng.randint(0, lm_scoring.LEAVES, (4, 64)).astype(np.int16), rng.randint(0, lm_scoring.LEAVES, 64).astype(np.int16)
    loss = lambda flat: -lm_scoring.Network.of(flat).log_likelihoods(context, leaf).mean()
    before = net.flat().copy()
    net.step(context, leaf, 1.0)
    gradient = before - net.flat()
    for i in [*np.argsort(-np.abs(gradient))[:200:10], *rng.randint(0, len(before), 20)]:
        up, down = before.copy(), before.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - gradient[i]) < 2e-3


def test_weights_are_averaged_by_words(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEP", 1 << 30)
    df = docs([prose(i, 30) for i in range(12)])
    known, _ = lm_scoring.corpus_vocabulary(df)
    one = lm_scoring.train(df.coalesce(1), known, rounds=1, rate=1e-3)
    many = lm_scoring.train(df.repartition(70), known, rounds=1, rate=1e-3)
    # A partition that has all documents steps by the mean of the gradients that 70 partitions take.
    assert np.abs(one.out_bias - many.out_bias).max() < 1e-6 and np.abs(one.out - many.out).max() < 1e-6
    assert (one.flat() != lm_scoring.Network.start(known.unigram, known.slots).flat()).any()


def test_network_learns_both_sides(spark, docs):
    import random

    rng = random.Random(1)
    pattern = lambda: " ".join(f"{a} mid{a} {a}" for a in rng.choices("pqrs", k=40))
    texts = [pattern() for _ in range(300)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:30]]
    rows = {r.doc_id: r for r in lm_scoring.score(docs(texts + shuffled)).collect()}
    good = np.mean([rows[i].mean_log_likelihood for i in range(30)])
    bad = np.mean([rows[300 + i].mean_log_likelihood for i in range(30)])
    assert good > bad + 0.1


def test_scores_of_odd_texts(docs):
    rows = {r.doc_id: r for r in lm_scoring.score(docs([*ODD, prose(1), prose(1)], extra=True)).collect()}
    assert len(rows) == len(ODD) + 2
    assert rows[0].n_words == 0 and rows[0].log_likelihood == 0 and rows[0].mean_log_likelihood is None
    assert rows[len(ODD)].log_likelihood == pytest.approx(rows[len(ODD) + 1].log_likelihood)
    assert all(r.log_likelihood <= 0 for r in rows.values() if r.n_words)
    assert lm_scoring.score(docs([])).count() == 0


# Ids


def test_large_ids_survive_nulls(spark, docs):
    big = 2**60 + 1
    df = docs([(big, prose(1)), (None, prose(2)), (big + 2, prose(3))])
    for out in (near_dedup.near_duplicates(df), licenses.scan(df), lm_scoring.score(df), quality_classifier.quality_scores(df, labels(spark, [(big, 1, 0)]))):
        assert {r.doc_id for r in out.select("doc_id").collect()} == {big, None, big + 2}
        assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    pages = spark.createDataFrame([(big, "u", ARTICLE), (None, "u", ARTICLE)], "page_id long, url string, html string")
    assert {r.page_id for r in html_extract.extract_pages(pages).collect()} == {big, None}


# Registry


def test_each_operator_has_one_query():
    numbers = collections.Counter(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries() if q.startswith("op"))
    assert numbers == collections.Counter(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
