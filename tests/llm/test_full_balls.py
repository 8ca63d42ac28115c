"""Near-duplicates where balls are full: no pair is lost there, and texts that are a little less alike make few pairs."""

import random

from cartoflow.llm import simhash

WORDS = [f"{a}{b}{c}" for a in "bcdfgklmnp" for b in "aeiou" for c in range(100)]


def kept(spark, texts, parts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.deduplicated(df, parts=parts).select("doc_id").collect()}


def test_full_balls_lose_no_pair(spark, monkeypatch):
    """With parts of six bits each ball has a good many of 1,200 strangers; pairs are at exactly 0.8."""
    monkeypatch.setattr(simhash, "PART_BITS", 6)
    r, texts = random.Random(3), []
    for _ in range(60):
        first = r.choices(WORDS, k=49)  # 45 shingles, five of them changed
        second = list(first)
        second[24] = "other"
        texts += [" ".join(first), " ".join(second)]
    strangers = [" ".join(r.choices(WORDS, k=49)) for _ in range(1200)]
    assert kept(spark, texts + strangers, 2) == set(range(0, 120, 2)) | set(range(120, 1320))


def test_less_alike_texts_of_one_form_make_few_pairs(spark, monkeypatch):
    """Two words of 24 are a text's own: similarities are near 0.4, balls of two parts of six bits hold most of them."""
    monkeypatch.setattr(simhash, "PART_BITS", 6)
    r, form = random.Random(4), random.Random(5).choices(WORDS, k=24)
    texts = [" ".join([*form[:8], f"x{i}", *form[9:16], f"y{i}", *form[17:]]) for i in range(1000)]
    r.shuffle(texts)
    compared, similar_pairs = [], simhash.similar_pairs

    def told(pairs, *rest):
        compared.append(pairs.count())
        return similar_pairs(pairs, *rest)

    monkeypatch.setattr(simhash, "similar_pairs", told)
    assert kept(spark, texts, 2) == set(range(1000))
    assert sum(compared) < 5 * len(texts)
