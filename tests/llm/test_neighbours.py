"""Neighbour voting: term counts and votes against loops, held-out accuracy on planted kinds, nulls, repeats, clashes."""

import math
import random
import zlib

import numpy as np
import pytest

from cartoflow.llm import neighbours
from cartoflow.llm.common import Block

LABELS = "doc_id long, quality int, toxic int"


def slow_marks(raw):
    """Outline of a text, symbol by symbol."""
    out, before, at = [], None, 0
    words = raw.replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").replace(b"\n", b" ")
    again = set()
    for word in words.split(b" "):
        if word:
            if word == before:
                again.add(at)
            before = word
        at += len(word) + 1
    for i, b in enumerate(raw + b"\n"):
        c = 1 if i in again else ord("a") if chr(b).isascii() and chr(b).islower() or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b
        if not out or c != out[-1] or c == 10:
            out.append(c)
    return out


def slow_counts(raw):
    def buckets(codes, k):
        row = np.zeros(neighbours.HALF)
        for i in range(len(codes) - k + 1):
            h = (k * 0x85EBCA6B + sum(int(c) * int(f) for c, f in zip(codes[i : i + k], neighbours._FACTORS, strict=False))) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            row[h >> 21] += 1
        return row

    marks = slow_marks(raw)
    return np.concatenate([sum(buckets(marks, k) for k in (2, 3, 4)), buckets(list(raw + b"\n"), 3)])


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_term_counts(monkeypatch, size):
    monkeypatch.setattr(neighbours, "SLICE", size)
    raw = [b"", b"a", b"The The the\n\nX9 x9 x9 $$ \xc3\xa9\xc3\xa9", b" \n ", b"same", b"same", b"one two one two two  two\ttwo"]
    got = neighbours.counted(Block(raw))
    for row, text in zip(got, raw, strict=True):
        assert (row == slow_counts(text)).all(), text


def kinds(n=260, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ne", "ti", "ro", "lu", "sch", "ing"]) for _ in range(r.randrange(1, 4)))
    prose = lambda: " ".join(". ".join(" ".join(word() for _ in range(r.randrange(4, 9))).capitalize() for _ in range(2)) for _ in range(8)) + "."
    junk = [lambda: " | ".join(word() for _ in range(60)), lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " ".join([word().capitalize()] * 50)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, r.choice(junk)() if bad else prose()))
        if i % 8 or i % 3 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_and_votes(spark):
    rows, labels = kinds()
    extra = [(None, rows[0][1]), (1000, None), (1001, ""), (1002, "é" * 3_000_000), *rows[3:6]]
    labels += [(3, None, 0), (labels[0][0], 1, 0), (5000, 1, 0)]  # a null label, a second one, one without a document
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS label", "'x' AS vector", "true AS held_out", "2 AS part", "0.0 AS score")
    told = spark.createDataFrame(labels, LABELS)
    got = neighbours.scored(docs, told)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(extra)
    score = {r["doc_id"]: r for r in out}
    assert all(r["held_out"] == held(i) for i, r in score.items() if i is not None) and score[None]["held_out"] is None
    wrong = [i for i, _ in rows if held(i) and score[i]["predicted"] != int(i % 4 != 0)]
    assert len(wrong) <= 2
    assert score[None]["score"] < 0.5

    # The votes again by loops, from the fitted vectors.
    model = neighbours.fit(docs, told)
    first = {}
    for i, q, _ in labels:
        if q is not None and not held(i):
            first[i] = min(q, first.get(i, 1))
    share = sum(first.values()) / len(first)
    assert math.isclose(model.share, share) and len(model.label) == len(first) - (5000 in first)
    for i, text in rows[:40] + [(1001, "")]:
        z = model.placed(Block([text.encode()]))[0]
        sims = [max(0.0, float(np.dot(z, v))) for v in model.vectors]
        last = sorted(sims)[-neighbours.NEAREST]
        pairs = [(s**neighbours.SHARPNESS * w, y) for s, y, w in zip(sims, model.label, model.votes, strict=True) if s >= max(last, 1e-6)]
        want = (sum(v * y for v, y in pairs) + neighbours.LEAST_VOTE * share) / (sum(v for v, _ in pairs) + neighbours.LEAST_VOTE)
        assert math.isclose(score[i]["score"], want, abs_tol=1e-4)
    assert math.isclose(score[1001]["score"], share) and math.isclose(score[1000]["score"], share)


def test_labels_alone_are_learnt_from(spark):
    """Held-out labels, and other columns of the documents, change no score."""
    rows, labels = kinds(80, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    flipped = [(i, 1 - q if held(i) else q, 1) for i, q, _ in labels]
    a = neighbours.scored(docs.selectExpr("*", "'en' AS lang", "'s' AS source"), spark.createDataFrame(labels, LABELS)).collect()
    b = neighbours.scored(docs.selectExpr("*", "'de' AS lang", "'t' AS source"), spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_sample_is_bounded_and_votes_are_scaled(spark):
    rows, labels = kinds(200, 2)
    model = neighbours.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), sample=10)
    own = {q: sum(1 for i, x, _ in labels if x == q and not held(i)) for q in (0, 1)}
    assert len(model.label) == 20
    assert all(math.isclose(v, own[int(y)] / 10) for v, y in zip(model.votes, model.label, strict=True))


def test_degenerate_labels(spark):
    rows, labels = kinds(40, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in neighbours.scored(docs, empty).collect()} == {0.5}
    assert {r["score"] for r in neighbours.scored(docs, spark.createDataFrame([(i, 0, 0) for i, *_ in labels], LABELS)).collect()} == {0.0}
    assert neighbours.scored(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []
