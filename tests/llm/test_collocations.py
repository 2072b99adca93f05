"""Collocations against brute force, tries against sets, and odd tables."""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from locengine.llm import collocations as module
from locengine.llm.collocations import Trie, blocks, build, collocations, phrase_counts

SCHEMA = "doc_id long, text string, lang string, rank string, a int, `grp` int"


def pieces(text):
    lower = (text or "").encode().lower().decode()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
        yield re.findall(r"[^\x20\x09]+", piece)


def by_force(rows, longest=3, least=10, inside=50, first=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    own = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = {}
    for (lang, w), a in own.items():
        within = any(
            g == lang and len(x) > len(w) and 100 * c >= inside * a
            and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
            for (g, x), c in own.items()
        )
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        if not within:
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    made = []
    for lang, found in out.items():
        for rank, (score, a, w, left, right) in enumerate(sorted(found)[:first], 1):
            made.append((lang, rank, w.decode(), -a, left, right, n[lang], -score))
    return sorted(made)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "Straße", "x-y", "\U0001f600", "a b"]
    fixed = ["New York City", "new  york", "New\tYork state", "on the other hand"]
    out = []
    for i in range(600):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words[: rng.randrange(1, 19)]))
            parts.append(rng.choice([" "] * 12 + ["  ", ". ", ",", "\n", "\r\n", "\v", "; "]))
        out.append((i, "".join(parts), rng.choice(["en", "en", "fr", None, "und"]), "x", 1, 2))
    out += [(900, None, "en", "x", 1, 2), (901, "", "en", "x", 1, 2), (None, "w1 w2", None, None, 1, 2)]
    out += [(902, " . , \n", "de", "x", 1, 2)] + [(903, "tie up tie up", "tie", "x", 1, 2)] * 12
    return out


def result(df, **options):
    made = collocations(df, **options)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in made.collect())


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = by_force(rows)
    assert len(want) > 100 and {w[0] for w in want} >= {"en", "fr", "und", "tie"}
    assert result(df) == want


def test_shards_longer_phrases_and_limits(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(df, entries=40) == by_force(rows)
    assert result(df, longest=5, least=7, inside=80, first=9) == by_force(rows, 5, 7, 80, 9)
    assert result(df, longest=2) == by_force(rows, 2)


def test_texts_are_read_as_often_for_many_shards(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("cast(coalesce(text, '') as binary) text", "'en' grp")
    read, scan = [], module._scan
    monkeypatch.setattr(module, "_scan", lambda *a: read.append(1) or scan(*a))
    few = {(r.grp, r.phrase): r.f for r in phrase_counts(df)[0].collect()}
    once = len(read)
    many = {(r.grp, r.phrase): r.f for r in phrase_counts(df, entries=20)[0].collect()}
    assert many == few and len(few) > 100 and once == len(read) - once == 4


def test_long_text_is_cut_without_loss(spark, monkeypatch, rows):
    monkeypatch.setattr(module, "BLOCK", 64)
    text = " ".join(r[1] for r in rows if r[1]).replace("\n", " ").replace(".", " ")
    starts, seen = 0, Counter()
    for block, groups in blocks([text.encode(), None, b"", b"w1 w2"], ["en", "fr", "fr", "en"], 3):
        assert groups == ["en", "fr"]
        starts += block.starts
        for i in range(block.starts):
            run = 1
            while run < 3 and block.joined[i + run - 1]:
                run += 1
            for n in range(1, run + 1):
                seen[block.phrase(i, n).decode()] += 1
    want = Counter()
    for t in (text, "w1 w2"):
        for w in pieces(t):
            for n in range(1, 4):
                want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    assert seen == want and starts == sum(len(w) for t in (text, "w1 w2") for w in pieces(t))


def test_very_long_text(spark):
    text = "alpha beta gamma, " * 300_000
    made = result(spark.createDataFrame([(1, text, "en", "", 0, 0)], SCHEMA))
    assert made == [("en", 1, "alpha beta gamma", 300_000, 300_000, 300_000, 900_000, 1_000_000)]


def test_candidates_do_not_rest_on_hashes(spark, rows):
    """A bound that is shared lets more candidates through, and counts stay the same."""
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("cast(coalesce(text, '') as binary) text", "'en' grp")
    exact = {(r.grp, r.phrase): r.f for r in phrase_counts(df)[0].collect()}
    loose = {(r.grp, r.phrase): r.f for r in phrase_counts(df, least=1)[0].collect()}
    assert len(loose) > len(exact) > 50
    assert {k: loose[k] for k in exact} == exact
    assert all(f < 10 for k, f in loose.items() if k not in exact and " " in k[1])


@pytest.mark.parametrize("n, vocabulary", [(1, 1), (40, 5), (3000, 60), (20_000, 3000)])
def test_double_array(n, vocabulary):
    rng = np.random.default_rng(n)
    size = rng.integers(2, 5, n)
    rows = rng.zipf(1.3, (n, 4)) % vocabulary
    rows[np.arange(4) >= size[:, None]] = -1
    rows = np.unique(rows, axis=0)
    radix = max(2, int(vocabulary**0.5) + 1)
    base, check, accept = build(rows, radix)
    assert sorted(accept[accept >= 0].tolist()) == list(range(len(rows)))

    def walk(symbols):
        s = 0
        for x in symbols:
            for d in (x // radix, x % radix):
                t = base[s] + d
                if check[t] != s:
                    return None
                s = t
        return int(accept[s])

    have = {tuple(x for x in r if x >= 0): i for i, r in enumerate(rows.tolist())}
    for r, i in have.items():
        assert walk(r) == i
    for _ in range(2000):
        r = tuple(int(x) for x in rng.integers(0, vocabulary, rng.integers(1, 5)))
        assert walk(r) in ((have[r],) if r in have else (None, -1))


def test_walk_counts_all_positions():
    names = [b"a", b"b"]
    rows = np.array([[2, 0, -1], [2, 0, 1], [2, 1, 1]])
    trie = Trie(pickle.dumps((2, *build(rows, 2), b"\n".join(names), ["en"])))
    found = Counter()
    for block, groups in blocks([b"a b b a b. b c a", b"a b"], ["en", "xx"], 2):
        for k in trie.accepted(block, groups, 2):
            found.update(k.tolist())
    assert found == {0: 3, 1: 2, 2: 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert result(none) == [] and phrase_counts(none.selectExpr("cast(text as binary) text", "lang grp"))[0].collect() == []
    assert result(spark.createDataFrame([(1, "a b c", None, "", 0, 0)], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, None, None, "", 0, 0)] * 20, SCHEMA)) == []
