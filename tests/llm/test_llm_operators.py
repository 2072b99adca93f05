"""The operators on small tables: against brute force, and with nulls, empty texts and clashes."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from locengine.llm import (
    decontaminate,
    fingerprints,
    html,
    jaccard,
    langid,
    licenses,
    mixing,
    substrings,
    urls,
    warc,
)
from locengine.llm.components import components
from locengine.llm.words import Words

SCHEMA = "doc_id long, text string, n_words string, source string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    base = words(rng, 120)
    passage = words(rng, 50)
    for i in range(60):
        text = words(rng, rng.choice([1, 2, 4, 30, 90, 200]))
        if i % 6 == 0:
            text = list(base)
            for _ in range(i // 12):
                text[rng.randrange(len(text))] = f"x{rng.randrange(999)}"
        elif i % 6 == 1:
            text = text[:40] + passage + text[40:]
        out.append((i, " ".join(text), "clash", f"s{i % 3}"))
    out += [(60, out[6][1].upper(), "c", None), (61, None, "c", "s0"), (62, "", "c", "s1")]
    out += [(63, " \t\n", "c", "s1"), (64, out[7][1], "c", "s2"), (64, out[7][1], "c", "s2")]
    out += [(None, "no id here at all", None, None), (65, "a b " * 60, "c", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def groups_by_force(rows, n, percent):
    sets = [shingles(t, n) for _, t, *_ in rows]
    name = list(range(len(rows)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                name[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, row in enumerate(rows):
        least[root(i)].append(row[0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(
        ((r[0], len(sets[i]), ids[root(i)]) for i, r in enumerate(rows)), key=str
    )


@pytest.mark.parametrize("n,percent,small", [(3, 90, 32), (5, 80, 1), (3, 50, 1)])
def test_jaccard_groups(docs, rows, monkeypatch, n, percent, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = [tuple(r) for r in jaccard.near_groups(docs, n=n, percent=percent).collect()]
    assert sorted(got, key=str) == groups_by_force(rows, n, percent)


def test_keep_one_of_each_group(docs, rows, none):
    kept = jaccard.keep_one(docs, n=3, percent=90)
    assert kept.columns == docs.columns
    want = groups_by_force(rows, 3, 90)
    alone = [r for r in want if r[1] == 0]
    names = {r[2] if r[2] is not None else "none" for r in want if r[1]}
    assert kept.count() == len(alone) + len(names)
    assert jaccard.keep_one(none).count() == 0


def test_copies_that_pivots_connect_give_no_pairs(spark, monkeypatch):
    """Two by two, 40 copies share a change: they are alone in its buckets, but all are linked
    with the first text. Signatures of 80 percent are sent in two passes."""
    plain = [f"w{i}" for i in range(300)]
    texts = [" ".join(plain)]
    for i in range(40):
        own = list(plain)
        own[i] = f"own{i}"
        own[100 + i // 2 * 5] = f"two{i // 2}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = []

    def noted(made, name, write=jaccard.materialise):
        table = write(made, name)
        tables.append((name, table))
        return table

    monkeypatch.setattr(jaccard, "materialise", noted)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    got = jaccard.near_groups(df, n=5, percent=80).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 41
    assert sum(table.count() for name, table in tables if name == "pairs") == 0
    signed = [table.where("signature is not null").count() for name, table in tables if name == "signed"]
    assert len(signed) == 2 and 3 * max(signed) < 2 * sum(signed)


def far_copies(n):
    """Copies of one text with up to 60 changes, of which many are linked with none or few."""
    rng, plain = random.Random(11), [f"w{i}" for i in range(200)]
    for _ in range(n):
        own = list(plain)
        for _ in range(int(rng.random() ** 2 * 60)):
            own[rng.randrange(200)] = f"x{rng.randrange(1 << 30)}"
        yield " ".join(own)


def least_ids(texts, n, percent):
    """Per text the least number that links reach."""
    sets = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                least, most = sorted((root[i], root[j]))
                root = [least if r == most else r for r in root]
    return root


@pytest.mark.parametrize("nodes", [1 << 15, 20, 0])
def test_a_group_of_far_copies_is_compared_without_its_differences(spark, monkeypatch, nodes):
    """No table of a group's differences from pivots, whose rows grow with the square of a group;
    groups too large for one task (nodes) are still split."""
    texts = list(far_copies(160))
    tables = []

    def noted(made, name, write=jaccard.materialise):
        tables.append((name, made.columns))
        return write(made, name)

    monkeypatch.setattr(jaccard, "materialise", noted)
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "MOST_NODES", nodes, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in jaccard.near_groups(df, n=5, percent=80).collect()}
    want = least_ids(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < 140
    if nodes > len(texts):
        assert not any("difference" in columns for _, columns in tables)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_spanning_links_connect_what_is_linked(percent):
    texts = list(far_copies(120)) + ["w1 w2", "w1 w2 w3 w4", "one two three four five"]
    sets = jaccard._shingles([t.encode() for t in texts], 3)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    links = jaccard.spanning(np.concatenate(sets), offsets, percent)
    root = list(range(len(texts)))
    for i, j in links:
        assert root[i] != root[j]
        assert (100 + percent) * len(np.intersect1d(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j]))
        least, most = sorted((root[i], root[j]))
        root = [least if r == most else r for r in root]
    want = [0] * len(texts)
    for i, a in enumerate(sets):
        want[i] = i
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if want[i] != want[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                least, most = sorted((want[i], want[j]))
                want = [least if r == most else r for r in want]
    assert root == want


def test_signatures_meet_for_linked_sets():
    rng = np.random.default_rng(5)
    frequent = np.zeros(0, dtype=np.uint64)
    for size in (1, 5, 9, 20, 57, 300):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for percent in (80, 90):
            for _ in range(30):
                gone = rng.integers(0, max(1, size * (100 - percent) // percent) + 1)
                b = np.sort(rng.permutation(a)[: len(a) - gone])
                if not len(b) or 100 * len(b) < percent * len(a):
                    continue
                common = [frequent, np.sort(a[::2]), a][rng.integers(3)]
                mark, of = jaccard.signatures([a, b], percent, common)
                assert set(mark[of == 0]) & set(mark[of == 1])


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size, other in [(0, 0), (0, 3), (1, 1), (60, 70), (64, 65), (300, 250), (5000, 4100)]:
        pool = np.unique(rng.integers(0, 1 << 63, size + other, dtype=np.uint64))
        a, b = pool[:size], np.sort(np.concatenate((pool[size // 2 : size], pool[size:])))[:other]
        least = jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b))
        assert least == jaccard.least_difference(jaccard.sketch(b), jaccard.sketch(a))
        assert least <= len(np.setxor1d(a, b))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(a)) == 0
    far = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    assert jaccard.least_difference(*map(jaccard.sketch, far)) > 300


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (3, 1), (7, 6)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict((r.node, r.label) for r in got) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}


def removed_by_force(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    count = collections.Counter(
        tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1)
    )
    out = []
    for row, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((row[0], len(w), sum(gone), " ".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 10, 3])
def test_substrings(docs, rows, window):
    made = substrings.remove_repeats(docs, window=window)
    assert set(made.columns) == {*SCHEMA_NAMES, "n_removed", "spans", "kept"}
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in made.collect()]
    assert sorted(got, key=str) == removed_by_force(rows, window)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def test_substrings_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, rows, none):
    items = [(1, rows[7][1]), (2, "w1 w2"), (3, None), (4, ""), (None, "w3"), (2, "w5"), (9, "W7.w8")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))

    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    want = []
    for row in rows:
        w = split(row[1])
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        bad = bool(hit) and 20 * len(hit) >= len(w)
        want.append((row[0], len(w), len(hit), sorted(found), bad))
    for size in (1 << 24, 40):
        made = decontaminate.decontaminate(docs, bench, block_bytes=size)
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in made.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(none, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench.limit(0))
    assert clean.where("contaminated").count() == 0


def test_fingerprints(docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = collections.defaultdict(list)
    for r in fingerprints.compare_with_next(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, row in enumerate(order):
        text, other = row[1] or "", order[(i + 1) % len(order)][1] or ""
        made = fingerprints.edited(text, other)
        (mine, *_) = got[row[0]]
        assert mine.n_chars == len(text)
        hashes = {x.edited_sha256 for x in got[row[0]]}
        assert hashlib.sha256(made.encode()).hexdigest() in hashes or row[0] in (63, 64)
    assert got[61][0].fingerprint == got[62][0].fingerprint == ""
    assert fingerprints.compare_with_next(none).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    both = np.concatenate((a, b[:2500]))
    sa, sb = fingerprints.sketch(a), fingerprints.sketch(both)
    assert np.array_equal(fingerprints.merge(sa, fingerprints.sketch(b[:2500])), sb)
    assert abs(fingerprints.resemblance(sa, sb) - 2 / 3) < 0.15
    assert fingerprints.containment(sa, sb) > 0.8
    assert 0.7 < fingerprints.distinct(sb) / 7500 < 1.4
    assert np.array_equal(fingerprints.from_text(fingerprints.as_text(sa)), sa)


def test_word_hashes_follow_the_words():
    texts = [b"a bb  ccc", b"", b"bb ccc\x0bd\xc3\xa9", b"a bb ccc"]
    made = Words(texts)
    assert np.diff(made.bounds).tolist() == [3, 0, 3, 3]
    assert np.array_equal(made.shingles(3)[0], made.shingles(3)[3])
    assert made.hashes[1] == made.hashes[3] and len(set(made.hashes.tolist())) == 4


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("only text", "only text"),
        (
            '<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>x</a></nav>'
            '<div id="content"><h1>T</h1><p>Long text of the article &amp; more<br>of it.<p>Ok.</div>'
            '<aside>no</aside><div class="comments"><p>nice one</p></div><footer>f</footer>',
            "T\nLong text of the article & more of it.\nOk.",
        ),
        ("<p>a<script>x='<p>no'</script>b &lt;c&gt;<!-- no -->", "ab <c>"),
        ("<article><p>one<form><p>no</form><p>two", "one\ntwo"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "<section>" + "<p>A long paragraph of the article, with many words in it.</p>" * 40 + "</section>"


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=x>x</a></nav><article><h1>T</h1><p>Lead</p>{LONG}<p>End</p></article>no",
        f"<article><h1>T</h1><p>Lead</p>{LONG}<section><p>End</p></section></article><p>no",
        f"<main><h1>T</h1><article><p>Lead</p>{LONG}</article><p>End</p></main><footer>no</footer>",
        f"<div><h1>T</h1><p>Lead</p></div><div>{LONG}</div><footer>no</footer><ul><li>End</ul>",
        f"<div id=content><h1>T</h1><p>Lead</p>{LONG}<pre>End</pre></div><div>no</div>",
        f"<td><a href=x>no</a></td><h1>T</h1><p>Lead</p>{LONG}<div>End</div>",
    ],
)
def test_main_text_keeps_all_of_the_region(page):
    lines = html.main_text(page).split("\n")
    assert (lines[:2], lines[-1], len(lines)) == (["T", "Lead"], "End", 43)


TEXT = "<p>Words of the article, long enough to count.</p><p>More of them in it.</p>"
WORDS = "Words of the article, long enough to count.\nMore of them in it."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><form><nav><a href=x>x</a></nav><input><div>{TEXT}</div></form></body>", WORDS),
        (f"<form><article>{TEXT}</article><footer>no</footer></form>", WORDS),
        (f"<div class=ad>no<article>{TEXT}</article>", WORDS),
        (f"<div class=ad>no<article>{TEXT}</article></div><p>no", WORDS),
        (f"<nav><ul><li><a href=x>x</a></ul><article>{TEXT}</article>", WORDS),
        (f"<aside>no<main>{TEXT}</main>", WORDS),
        (f"<article>{TEXT}</article><div class=comments><article>no {TEXT}</article></div>", WORDS),
        (f"<article>{TEXT}</article><aside><article>no {TEXT}</article></aside>", WORDS),
        (f"<div hidden><article>no</article></div><article>{TEXT}</article>", WORDS),
        (f"<article>{TEXT}<ul>{'<li><a href=x>a</a>' * 3}</ul></article>", WORDS + "\na" * 3),
        (f"<ul>{'<li><a href=x>a</a>' * 3}</ul>{TEXT}", WORDS),
    ],
)
def test_main_text_of_wrapped_and_unclosed(page, text):
    assert html.main_text(page) == text


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "<p>hé", "y")], "page_id long, html string, n_chars string")
    got = {r.page_id: (r.main_text, r.n_chars) for r in html.extract_text(pages).collect()}
    assert got == {1: ("", 0), 2: ("hé", 2)}


def test_licenses(spark):
    texts = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0. And more"),
        (2, "Licensed under the Apache License, Version 1.1"),
        (3, "this work is licensed under the gnu general public license version 3"),
        (4, None),
        (5, "You have a license to look. Released under the MIT License."),
        (6, "Permission is hereby granted, free of charge, to any person getting a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ]
    made = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: r for r in made.collect()}
    assert [got[i].license for i in range(1, 7)] == ["Apache-2.0", None, "GPL-3.0", None, "MIT", "MIT"]
    assert [tuple(d) for d in got[6].licenses[0].differences] == [("obtaining", "getting")]


@pytest.mark.parametrize("change", [str.upper, str.title, lambda t: t.replace(" ", "  \n * ")])
def test_licenses_in_any_case_and_spacing(change):
    rng = random.Random(11)
    scanner = licenses.Scanner()
    for name, wording in licenses.TEMPLATES:
        around = [" ".join(words(rng, rng.randrange(3, 90))) for _ in range(2)]
        found = scanner.scan(f"{around[0]} {change(wording)} {around[1]}")
        assert [x["license"] for x in found] == [name], wording


BSD = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions
   and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
   conditions and the following disclaimer in the documentation and/or other materials.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
THIRD = """Neither the name of the holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
ADVERTS = """All advertising materials mentioning features or use of this software must display the
following acknowledgement: This product includes software developed by the holder."""
GNU = """This {} is free software; you can redistribute it and/or modify it under the terms of the
GNU {} Public License as published by the Free Software Foundation; either version {} of the
License, or (at your option) any later version."""


@pytest.mark.parametrize(
    "text,names",
    [
        (BSD.format(""), ["BSD-2-Clause"]),
        (BSD.format("3. " + THIRD), ["BSD-3-Clause"]),
        (BSD.format("3. " + ADVERTS + "\n4. " + THIRD), ["BSD-4-Clause"]),
        (BSD.format("") + " word" * 400 + " " + BSD.format(THIRD), ["BSD-2-Clause", "BSD-3-Clause"]),
        (THIRD, []),
        (GNU.format("program", "General", "2"), ["GPL-2.0"]),
        (GNU.format("program", "General", "3"), ["GPL-3.0"]),
        (GNU.format("library", "Library General", "2"), ["LGPL-2.0"]),
        (GNU.format("library", "Lesser General", "2.1"), ["LGPL-2.1"]),
        (GNU.format("program", "Lesser General", "3"), ["LGPL-3.0"]),
        (GNU.format("program", "Affero General", "3"), ["AGPL-3.0"]),
        (GNU.format("program", "General", "4"), []),
        ("under a Creative Commons Attribution 4.0 International License", ["CC-BY-4.0"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 3.0", ["CC-BY-NC-SA-3.0"]),
        ("Creative Commons Attribution-Share Alike 2.5 Generic", ["CC-BY-SA-2.5"]),
        ("see https://creativecommons.org/licenses/by-nd/4.0/", ["CC-BY-ND-4.0"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", ["GPL-2.0"]),
        ("Mozilla Public License Version 2.0\n=====", ["MPL-2.0"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n"
         "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: LGPL-2.1-only", ["LGPL-2.1"]),
    ],
)
def test_licenses_by_their_notices_and_texts(text, names):
    found = licenses.Scanner().scan(f"some words before {text} and after")
    assert [x["license"] for x in found] == names


RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block")]


def test_url_filter(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?y", "<p>good news good news</p>"),
        (2, "https://goodnews.org#x", None),
        (3, None, "bad"),
        (4, "no scheme", ""),
        (5, "http://a.com", ""),
        (6, "http://a.com/b", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.filter_urls(pages, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == (
        "www.example.com", "/en/x", "example.com/en/", "block",
    )
    assert got[2].words == ["good", "news", "org"] or got[2].words[:2] == ["good", "news"]
    assert (got[3].host, got[4].host, got[3].rule) == ("", "", None)
    assert got[5].rule is None and got[6].rule == "com/"
    assert urls.filter_urls(pages.limit(0), RULES).count() == 0


def test_warc_salvages_what_follows_damage():
    raws = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:row:{i}>"}, b"x" * 500 * i)
            for i in range(5)]
    packed = [warc.member(r) for r in raws]
    broken = bytearray(packed[1])
    broken[len(broken) // 2] ^= 255
    data = packed[0] + bytes(broken) + b"junk" + raws[2] + packed[3][:-20] + packed[4]
    found = list(warc.salvage(data))
    ids = [f.headers["warc-record-id"] for f in found if isinstance(f, warc.Record)]
    assert ids == ["<urn:row:0>", "<urn:row:2>", "<urn:row:4>"]
    gaps = [f for f in found if isinstance(f, warc.Gap)]
    assert [(g.offset, g.end) for g in gaps] == [
        (len(packed[0]), len(packed[0] + packed[1]) + 4),
        (len(data) - len(packed[4]) - len(packed[3]) + 20, len(data) - len(packed[4])),
    ]


def test_warc_round_trip(spark, tmp_path):
    big = "ä" * 800
    rows = [(1, "u1", big), (5, "u\n5", big), (3, None, big), (2, "u2", "s"), (4, "u4", "s"), (6, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.gap is None for r in back)
    got = {r.record_id: (r.type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back}
    for number, _, text in rows:
        raw = (text or "").encode()
        visit = number in (1, 3)
        assert got[f"<urn:row:{number}>"] == (
            "revisit" if visit else "response",
            "<urn:row:5>" if visit else None,
            len(raw),
            hashlib.sha1(raw).hexdigest(),
        )


def test_network_gradients(monkeypatch):
    monkeypatch.setattr(langid, "_FLOAT", np.float64)
    rng = np.random.default_rng(2)
    net = langid.new_network(["a", "b", "c"], 4, rng)
    data, label = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, grads = langid.gradients(net, data, label)
    for w, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-5
        above = langid.gradients(net, data, label)[0]
        w[at] -= 2e-5
        below = langid.gradients(net, data, label)[0]
        w[at] += 1e-5
        assert abs((above - below) / 2e-5 - g[at]) < 1e-6


def test_language_id_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = langid.fit(docs.where(~langid.held_out("doc_id")), steps=250)
    made = langid.identify(docs.where(langid.held_out("doc_id")), net).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in made)
    assert sum(r.lang == r.lang_pred for r in made) / len(made) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34!")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, net).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_every_language_is_sampled(spark):
    rows = [(f"text {i} {j} of it", f"l{i}") for i in range(450) for j in range(4)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    texts, langs = langid.training_sample(labelled, "text", "lang", per_language=4)
    counts = collections.Counter(langs)
    assert len(texts) == len(langs) and len(counts) == 450 and set(counts.values()) == {1}
    few = labelled.where("lang in ('l1', 'l2')")
    assert len(langid.training_sample(few, "text", "lang", per_language=3)[0]) == 6


def test_mixing(docs, none):
    made = mixing.mix(docs, max_repeats=2.0).collect()
    ids = collections.Counter(r.doc_id for r in made)
    assert set(ids) == {r.doc_id for r in docs.collect()}
    assert mixing.mix(none).count() == 0
    total = docs.select(mixing.tokens_of("text").alias("n")).groupBy().sum("n").first()[0]
    few = mixing.mix(docs, max_repeats=None, budget=total / 4, block_tokens=50).collect()
    assert 0 < sum(r.n_tokens for r in few) <= total / 4 + 4
    sources = docs.groupBy("source").agg({"text": "count"}).toDF("source", "tokens")
    flat = mixing.fit_exponent(sources, target_entropy=1.0)
    assert flat.exponent > 1


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_long_words_that_polynomials_take_for_equal(spark):
    """Different words whose polynomials modulo 2**64 are the same for every odd base."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(1, " ".join([one] * 35), None, None), (2, " ".join([two] * 35), None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = substrings.remove_repeats(df.select("doc_id", "text"), window=35)
    assert {r.doc_id: r.n_removed for r in made.collect()} == {1: 0, 2: 0}
    linked = jaccard.near_groups(df.select("doc_id", "text"), n=3, percent=90).collect()
    assert sorted(r.component_id for r in linked) == [1, 2]
    words = Words([one.encode(), two.encode()])
    assert words.hashes[0] != words.hashes[1]
