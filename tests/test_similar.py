"""Trigram joins against all pairs: thresholds, copies, words, other alphabets, texts without grams."""

import random
import re

import pytest

from cartoflow.operators import similar


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def names(n=150, seed=0):
    r = random.Random(seed)
    words = ["Sri", "Balaji", "Pooja", "Store", "Stores", "Bakery", "bakers", "Élan", "Café", "cafe", "1st", "दुकान", "x"]
    out = [(i, " ".join(r.choices(words, k=r.randrange(1, 5)))) for i in range(n)]
    out += [(n + i, "Sri  Balaji-Pooja store!") for i in range(60)]  # many of one set
    return out + [(900, None), (901, ""), (902, " .. "), (None, "Sri")]


def likeness(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75, 1.0])
def test_linked(spark, least):
    rows = names()
    got = {r["id"]: (r["class"], r["n_links"]) for r in similar.linked(spark.createDataFrame(rows, "id long, name string"), "id", "name", least).collect()}
    known = [(i, t) for i, t in rows if i is not None and grams(t)]
    want = {i: (min(j for j, u in known if grams(u) == grams(t)), sum(j != i and likeness(t, u) >= least - 1e-12 for j, u in known)) for i, t in known}
    assert got == want


def test_most_like(spark):
    rows = names(seed=1)
    asked = [(i, t) for i, t in rows if i is not None and i % 20 == 0] + [(5000, "Pooja stor"), (5001, "qqq"), (5002, None)]
    schema = "id long, name string"
    got = {}
    for r in similar.most_like(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), "id", "name", 5).collect():
        got.setdefault(r["query_id"], []).append((r["position"], r["id"], r["likeness"]))
    for q, t in asked:
        best = sorted((-round(likeness(t, u), 6), i) for i, u in rows if i is not None and likeness(t, u) >= 0.3)[:5]
        assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)], t


def test_bounds(spark):
    none = spark.createDataFrame([], "id long, name string")
    assert similar.linked(none, "id", "name", 0.5).collect() == []
    with pytest.raises(ValueError):
        similar.linked(none, "id", "name", 0.0)


def test_high_likeness_is_asked_first(spark, monkeypatch):
    """Queries that have k rows at a high likeness are not held against the many of a low one."""
    asked, like_pairs = [], similar.like_pairs

    def told(left, right, least):
        asked.append((round(least, 3), left.count()))
        return like_pairs(left, right, least)

    monkeypatch.setattr(similar, "like_pairs", told)
    rows = spark.createDataFrame([(i, f"Sri Balaji Pooja Store {i % 4}") for i in range(40)] + [(100, "Iron Gym"), (101, "Iron Gyms")], "id long, name string")
    got = {}
    for r in similar.most_like(rows.where("id in (0, 100)"), rows, "id", "name", 5).collect():
        got.setdefault(r["query_id"], []).append((r["position"], r["id"]))
    assert sorted(got[0]) == [(i + 1, 4 * i) for i in range(5)] and sorted(got[100]) == [(1, 100), (2, 101)]
    assert asked[0] == (0.8, 2) and asked[-1] == (0.3, 1)


@pytest.mark.parametrize("least", [0.3, 0.7, 1.0])
@pytest.mark.parametrize("pack", [7, 8192])
def test_links_of_few_grams_are_counted_without_pairs(spark, monkeypatch, least, pack):
    """Where lists hold nearly all pairs, links are counted in packs of classes, and no table of pairs is made."""
    r = random.Random(3)
    rows = [(i, " ".join([r.choice(["large", "hot", "light"]), r.choice(["ring", "bolt"]), f"brand{r.randrange(9)}", "no", str(r.randrange(20))])) for i in range(250)]
    rows += [(i, None if i % 2 else "bolt") for i in range(250, 260)]
    monkeypatch.setattr(similar, "MET", 0, raising=False)
    monkeypatch.setattr(similar, "PACK", pack, raising=False)
    monkeypatch.setattr(similar, "STRIP", 5, raising=False)
    monkeypatch.setattr(similar, "like_pairs", None)
    got = {r["id"]: (r["class"], r["n_links"]) for r in similar.linked(spark.createDataFrame(rows, "id long, name string"), "id", "name", least).collect()}
    known = [(i, t) for i, t in rows if grams(t)]
    want = {i: (min(j for j, u in known if grams(u) == grams(t)), sum(j != i and likeness(t, u) >= least - 1e-12 for j, u in known)) for i, t in known}
    assert got == want


@pytest.mark.parametrize("k, least, pack", [(1, 0.3, 7), (5, 0.3, 8192), (5, 0.6, 7), (40, 0.05, 7)])
def test_most_like_of_few_grams_is_found_without_pairs(spark, monkeypatch, k, least, pack):
    """Where lists hold nearly all pairs, the best rows are kept in the task of a pack, and no table of pairs is made."""
    r = random.Random(7)
    rows = [(i, " ".join([r.choice(["large", "hot", "light"]), r.choice(["ring", "bolt"]), f"brand{r.randrange(9)}", "no", str(r.randrange(20))])) for i in range(300)]
    rows += [(i, None if i % 2 else "Bolt, bolt") for i in range(300, 330)]
    asked = [x for x in rows if x[0] % 4 == 0] + [(5000, "large rings"), (5001, "qqq"), (5002, None), (5003, "large ring qqq"), (5004, "..")]
    monkeypatch.setattr(similar, "MET", 0)
    monkeypatch.setattr(similar, "PACK", pack)
    monkeypatch.setattr(similar, "STRIP", 5)
    monkeypatch.setattr(similar, "RUN", 2, raising=False)
    monkeypatch.setattr(similar, "HITS", 9, raising=False)
    monkeypatch.setattr(similar, "SUMS", 1e9)
    monkeypatch.setattr(similar, "like_pairs", None)
    schema, got = "id long, name string", {}
    for x in similar.most_like(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), "id", "name", k, least).collect():
        got.setdefault(x["query_id"], []).append((x["position"], x["id"], x["likeness"]))
    for q, t in asked:
        best = sorted((-round(likeness(t, u), 6), i) for i, u in rows if likeness(t, u) >= least)[:k]
        assert sorted(got.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)], t
    assert len(got) > 80


@pytest.mark.parametrize("least", [0.3, 0.75])
def test_pairs_of_short_sets_by_size(spark, least):
    """Sizes in the key leave the pairs as they are; what the left side has not is not in the index."""
    r = random.Random(10)
    words = ["large", "hot", "ring", "bolt", "k", "no"]
    of = lambda n, at: [(i, sorted({*r.choices(words, k=r.randrange(1, 6)), f"brand{r.randrange(3)}", str(at + i)} - ({str(at + i)} if i % 3 else set()))) for i in range(n)]
    a, b = of(40, 0), of(90, 5)
    left, right = (spark.createDataFrame(x, "class long, grams array<string>") for x in (a, b))
    got = {(x["a"], x["b"]): x["likeness"] for x in similar.like_pairs(left, right, least, by_size=True).collect()}
    likeness = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    assert got == {(i, j): likeness(x, y) for i, x in a for j, y in b if likeness(x, y) >= least - 1e-12} and got
