"""Recall of the near-duplicates stage on planted pairs: at its lowest similarity, and among so many strangers that balls
fill (narrow parts stand for a large corpus)."""

import random

import pytest

from cartoflow.llm import simhash

WORDS = [f"{a}{b}{c}" for a in "bcdfgklmnp" for b in "aeiou" for c in range(100)]


def pairs(r, n, size, changed):
    out = []
    for _ in range(n):
        first = r.choices(WORDS, k=size)
        second = list(first)
        for i in range(changed):
            second[(2 * i + 1) * size // (2 * changed)] = "other"
        out.append((" ".join(first), " ".join(second)))
    return out


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def found(spark, planted, strangers, parts):
    texts = [t for pair in planted for t in pair] + strangers
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    left = {r["doc_id"] for r in simhash.deduplicated(df, parts=parts).select("doc_id").collect()}
    assert left >= set(range(0, 2 * len(planted), 2)) | set(range(2 * len(planted), len(texts)))
    return sum(i not in left for i in range(1, 2 * len(planted), 2)) / len(planted)


def test_recall_at_the_least_similarity(spark):
    planted = pairs(random.Random(0), 300, 229, 5)  # 225 shingles, 25 of them changed
    assert all(len(grams(a) & grams(b)) / len(grams(a) | grams(b)) == 0.8 for a, b in planted)
    assert found(spark, planted, [], simhash.PARTS) >= 0.89


@pytest.mark.parametrize("strangers", [9000])
def test_recall_among_strangers(spark, monkeypatch, strangers):
    """With two parts of 14 bits a ball's value has about eight strangers, as a billion texts give it with 32."""
    monkeypatch.setattr(simhash, "PART_BITS", 14)
    r = random.Random(1)
    planted = pairs(r, 150, 60, 1)
    others = [" ".join(r.choices(WORDS, k=60)) for _ in range(strangers)]
    alone = found(spark, planted, [], 2)
    assert alone >= 0.85 and found(spark, planted, others, 2) >= 0.93 * alone
