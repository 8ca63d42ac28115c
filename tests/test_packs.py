"""Strings held against each other in packs, against all pairs one by one."""

import difflib
import random

import numpy as np
import pytest

from cartoflow.functions.fuzzy import token_set
from cartoflow.operators import packs


def column(spark, values, c):
    return spark.createDataFrame([(x,) for x in values], f"{c} string")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(packs, "PACK", 40)
    monkeypatch.setattr(packs, "STRIP", 7)


def test_best_entries_of_labels_that_share_their_words(spark):
    r = random.Random(5)
    labels = sorted({f"{r.choice(['large', 'hot'])} {r.choice(['ring', 'bolt'])} brand#{r.randrange(9)} k {i}" for i in range(60)} | {"short", "x" * 70, "दुकान पूजा"})
    asked = sorted({x[:3] + x[4:] for x in labels} | {" ".join(reversed(x.split())) for x in labels[:8]} | {"", "zz", "दकान पूजा"})
    found = packs.best_entries(column(spark, [*asked, None], "a"), column(spark, [*labels, None], "b"), 0.78, 4).collect()
    got = {}
    for x in found:
        got[x["a"]] = max(got.get(x["a"], (0.0, "")), (x["likeness"], x["b"]))
    want = {}
    for a in asked:
        near = [(difflib.SequenceMatcher(None, a, b).ratio(), b) for b in labels if abs(len(a) - len(b)) <= 4]
        if 0 < len(a) <= packs.LETTERS and near and max(near)[0] >= 0.78:
            want[a] = max(near)
    assert got == want and len(want) > 60


def test_token_sets_by_letters(spark):
    r = random.Random(6)
    digits = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    known = [f"area {digits(8)}" for _ in range(90)] + ["mg road"]
    asked = [x[:7] + x[8:] for x in known[:50]] + ["road m g", "once", "", "  "]
    found = packs.compared(column(spark, asked, "a"), column(spark, known, "b"), packs.token_sets(0.85)).collect()
    got = {(x["a"], x["b"]): x["likeness"] for x in found}
    for a in set(asked):
        for b in known:
            alike = token_set(a, b)
            assert got.get((a, b), 0.0) in (0.0, alike)
            if alike >= 0.85 and abs(len(a) - len(b)) <= 1:
                assert got[a, b] == alike


@pytest.mark.parametrize("least, apart", [(0.5, None), (0.78, 4), (0.95, 4), (0.78, 0), (1.0, None)])
@pytest.mark.parametrize("few", [True, False])
def test_best_typos_of_beginnings(monkeypatch, least, apart, few):
    """Keywords that walk down the beginnings of entries find what all pairs one by one say, however they are cut."""
    if few:
        for name, n in (("FRONT", 3), ("KEPT", 5), ("BITS", 40)):
            monkeypatch.setattr(packs, name, n, raising=False)
    r = random.Random(8)
    entries = {"".join(r.choice("abcé दुकान"[:n]) for _ in range(r.randrange(1, 30))) for n in (2, 4, 10) for _ in range(40)} | {"a", "ab", "abc", "x" * 66, "\U0001f600a"}
    asked = {("".join(x for x in e if r.random() > 0.1) + r.choice(["", "q"]))[: packs.LETTERS] for e in entries} | {"a", "ba", "zzz", "y" * packs.LETTERS, "x" * packs.LETTERS}
    asked, entries = sorted(asked - {""}), sorted(entries)
    got = {a: (s, b) for a, b, s in packs.best_typos(least, apart)(asked, entries)}
    want = {}
    for a in asked:
        near = [(s, b) for b in entries if (apart is None or abs(len(a) - len(b)) <= apart) and (s := difflib.SequenceMatcher(None, a, b).ratio()) >= least]
        if near:
            want[a] = max(near)
    assert got == want and want
    assert list(packs.best_typos(least, apart)([], entries)) == list(packs.best_typos(least, apart)(asked, [])) == []


def test_typos_are_not_looked_for_in_each_entry(monkeypatch):
    """Of entries that are made of the same words, beginnings that lead nowhere are left with all that follows them."""

    class Counting:
        n = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_count(self, x):
            Counting.n += x.size
            return np.bitwise_count(x)

    r = random.Random(9)
    label = lambda i: f"{r.choice(['large', 'hot', 'blue', 'old'])} {r.choice(['ring', 'bolt', 'gear', 'plate'])} brand#{r.randrange(1, 26)} {r.choice(['small', 'promo', 'economy'])} k {i}"
    entries = sorted(label(i) for i in range(20_000))
    asked = [x[:3] + x[4:] for x in entries[::400]] + [" ".join(reversed(x.split())) for x in entries[::400]]
    monkeypatch.setattr(packs, "np", Counting())
    found = {a: b for a, b, _ in packs.best_typos(0.95, 4)(asked, entries)}
    assert found == dict(zip(asked[:50], entries[::400], strict=True))
    assert Counting.n < len(asked) * len(entries) / 10
