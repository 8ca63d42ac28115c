"""The partial ratio over all pieces of a text at once, against each piece alone."""

import random

from cartoflow.functions import fuzzy


def slow(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max(fuzzy.indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def test_partial_is_that_of_the_best_piece():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc é\U0001f600") for _ in range(n))
    for n in (1, 2, 9, 62, 63, 64, 70):
        for m in (n, n + 1, 3 * n, 200):
            a, b = word(n), word(m)
            assert fuzzy.partial(a, b) == slow(a, b), (n, m)
    assert fuzzy.partial("", "") == 1.0 and fuzzy.partial("", "a") == 0.0


def test_partial_does_not_go_piece_by_piece(monkeypatch):
    monkeypatch.setattr(fuzzy, "indel_ratio", None)
    assert fuzzy.partial("the of and", "x" * 3000 + "the of and" + "y" * 2000) == 1.0
