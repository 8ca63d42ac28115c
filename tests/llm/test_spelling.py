"""Spelling variants against brute force, and their parts: neighbourhoods, filter, chains, nulls, repeats, clashes."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cartoflow.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """By definition, letter by letter: one replaced, or one of the longer left out."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in RUNS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        count[w], form[w] = len(others), best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def rows(seed):
    r = random.Random(seed)
    base = ["reading", "readings", "reeding", "bookkeeper", "bookeeper", "Bookkeepers", "caféteria", "cafeteria", "Éléphants", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaa"]
    weights = [400, 30, 3, 300, 20, 2, 200, 15, 9, 300, 20, 2, 2]
    out = [(None, None), (None, "READING, reading"), (1, ""), (2, "  \n"), (3, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999), (4, "short w0rds only; readingsx, readingsx")]
    for i in range(5, 60):
        out.append((i, " ".join(r.choice([str.lower, str, str.upper])(w) for w in r.choices(base, weights, k=40)) + r.choice(["", ".", "\n"])))
    return out + out[-2:]


@pytest.mark.parametrize("seed", [0, 1])
def test_spelling(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "FLUSH", 5)
    data = rows(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS n", "'x' AS word", "2 AS h", "'y' AS near", "true AS form")
    got = spelling.grouped(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(data)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert any(x[1] and x[2] != x[1] for x in want) and any(x[4] > 1 for x in want)


def test_spelling_of_nothing(spark):
    assert spelling.grouped(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.grouped(spark.createDataFrame([(1, None), (2, "one two")], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_neighbourhoods_are_full_and_distinct(monkeypatch, at_once):
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    words, letters = ["aab", "abc", "bbbb", "c"], "abc"
    mine, made = spelling.Words(words), [[] for _ in words]
    for kind, owner, place, letter, hashes in mine.neighbours(np.array([ord(x) for x in letters], np.uint64)):
        built = mine.built(kind, owner, place, letter)
        for w, text, h in zip(owner.tolist(), built, hashes, strict=True):
            made[w].append(text)
            assert not text or spelling.Words([text]).hashes()[0] == h
    for w, found in zip(words, made, strict=True):
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for a in letters} - {w}
        assert len(found) == len(set(found)) and set(found) == want


def test_filter_misses_no_word(spark, monkeypatch):
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    own, other = spelling.Words(words).hashes(), spelling.Words([w + "x" for w in words]).hashes()
    full = spelling.filter_of(df, len(words))
    assert len(full.having(own)) == len(words) and len(full.having(other)) < 60
    monkeypatch.setattr(spelling, "FILTER_BITS", spelling.SEGMENT_BITS)  # a filter that is too small still misses none
    assert len(spelling.filter_of(df, len(words)).having(own)) == len(words)


def test_chains_are_followed_to_the_last(spark):
    chain = [("w%d" % k, "w%d" % (k + 1)) for k in range(7)] + [("side", "w3")]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string"), 2 * 10**7)
    assert {tuple(r) for r in got.collect()} == {(w, "w7") for w, _ in chain}
