"""Patterns in texts, by automaton and by anchors, against containment of each in each."""

import random

import pytest

from cartoflow.operators import patterns


@pytest.mark.parametrize("most", [patterns.AUTOMATON_BYTES, 0])
def test_occurring(spark, most):
    r = random.Random(0)
    texts = [(i, "".join(r.choice("abcé ") for _ in range(r.randrange(60)))) for i in range(200)] + [(300, None), (301, ""), (None, "abab"), (0, "abcabc" * 2000)]
    wanted = ["a", "ab", "aba", "abab", "ababab", "é a", "c", " ", "zzz", "bca" * 9, *("".join(r.choice("abcé ") for _ in range(r.randrange(1, 8))) for _ in range(60))]
    got = patterns.occurring(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in [*wanted, "a", "", None]], "p string"), "id", "t", "p", most).collect()
    want = sorted(((i, w) for i, t in texts for w in set(wanted) if t and w in t), key=repr)
    assert sorted(set(map(tuple, got)), key=repr) == sorted(set(want), key=repr)
    if most:
        assert sorted(map(tuple, got), key=repr) == want  # a row for each row of the texts


def test_nothing(spark):
    texts, none = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "pattern string")
    for most in (0, 1 << 20):
        assert patterns.occurring(texts, none, most=most).collect() == []
        assert patterns.occurring(texts.limit(0), spark.createDataFrame([("a",)], "pattern string"), most=most).collect() == []
