"""The vector index: exact answers against brute force, recall of the part search, skewed cells, ties, nulls, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflow.operators import vectors

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n=1500, d=16, seed=0):
    r = np.random.default_rng(seed)
    x = (r.standard_normal((25, d))[r.integers(0, 25, n)] + 0.4 * r.standard_normal((n, d))).astype(np.float32)
    x[200:700] = x[200]  # a third is one vector
    x[7] = 0
    return x


def frame(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, (90_000, None), (None, [0.0] * x.shape[1]), (90_001, [])], SCHEMA).repartition(4)


def brute(x, asked, k, least=-1.0):
    u = vectors.unit(x)
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 6) + 0.0
        order = np.lexsort((np.arange(len(s)), -s))[:k]
        out[q] = [(int(i), float(s[i])) for i in order if s[i] >= least]
    return {q: v for q, v in out.items() if v}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["position"])):
        assert r["position"] == len(out.get(r["query_id"], [])) + 1
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
    return out


def same(a, b):
    return a.keys() == b.keys() and all(len(a[q]) == len(b[q]) and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=2e-6) for q in a)


@pytest.mark.parametrize("probes, least", [(1, -1.0), (4, 0.55)])
def test_exact(spark, monkeypatch, probes, least):
    monkeypatch.setattr(vectors, "PACK", 50)
    monkeypatch.setattr(vectors, "DEALT", 120)
    monkeypatch.setattr(vectors, "ASKED", 16)
    x = clustered()
    table = frame(spark, x)
    index = vectors.build(table)
    assert sum(len(r["ids"]) for r in index.packs.collect()) == len(x)
    asked = table.where("vec_id % 20 = 0 OR vec_id IN (7, 201)")
    ids = sorted({*range(0, len(x), 20), 7, 201})
    got = listed(vectors.exact(asked, index, 10, least, probes))
    want = brute(x, ids, 10, least)
    assert same(got, want)
    assert got[201] == [(200 + i, 1.0) for i in range(10)]  # ties by id


def test_recall(spark):
    x = clustered(seed=1)
    table = frame(spark, x)
    index = vectors.build(table)
    asked = table.where("vec_id % 20 = 0")
    exact = vectors.exact(asked, index, 10)
    found = vectors.recall(vectors.search(asked, index, 10), exact).agg(F.avg("recall"), F.min("recall"), F.count("*")).first()
    assert found[0] >= 0.9 and found[2] == 75
    assert vectors.recall(vectors.search(asked, index, 10, probes=len(index.centroids)), exact).agg(F.min("recall")).first()[0] == 1.0


def test_registered_recall(spark):
    from cartoflow.plans.registry import QUERIES

    for sf in ("sf0.001", "sf0.1"):
        assert QUERIES["jon_10_recall"](spark, f"/root/testdata/{sf}").agg(F.avg("recall")).first()[0] >= 0.9


def test_nothing(spark):
    none = frame(spark, np.zeros((0, 4), np.float32))
    some = frame(spark, clustered(800, 4)[:30])
    assert vectors.exact(some, vectors.build(none.where("vec_id >= 90000")), 3).collect() == []
    assert vectors.exact(none.where("vec_id >= 90000"), vectors.build(some), 3).collect() == []


def test_fit_holds_its_sample_once():
    """What the driver needs beside the sample is some blocks, not copies of all of it."""
    import tracemalloc

    sample = np.random.default_rng(0).standard_normal((60_000, 32), dtype=np.float32)
    sample[1000:1400] = sample[0]  # equal members leave cells empty
    tracemalloc.start()
    found = vectors.centroids_of(sample, 64, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (64, 32) and peak < sample.nbytes
