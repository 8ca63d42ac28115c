"""Block counts and links without pairs against every pair: hot keys, crowded cells, copies, nulls."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cartoflow.functions import geo
from cartoflow.functions.fuzzy import token_sort
from cartoflow.resolve import blocks, entities

SCHEMA = "id long, name string, lon double, lat double, phone string, domain string"


def entities_of(seed, n=160):
    r = random.Random(seed)
    words = ["sri", "balaji", "pooja", "store", "stores", "iron", "gym", "gim", "city", "bakery", "bakeri", "new", "royal", "hotel"]
    rows = []
    for i in range(n):
        hot = r.random() < 0.6  # most rows are within one cell
        lon, lat = (77.5000 + r.choice([0, 0.0001, 0.0003, 0.0006]), 12.8000 + r.choice([0, 0.0002, 0.0005])) if hot else (77 + r.random(), 12 + r.random())
        name = " ".join(r.sample(words, r.randrange(1, 4))) + ("" if r.random() < 0.5 else r.choice(["s", "x", " 7"]))
        rows.append((i, name, lon, lat, "+911" if r.random() < 0.2 else None if r.random() < 0.7 else f"+91{i % 9}", "a.in" if r.random() < 0.15 else None if r.random() < 0.8 else f"d{i % 7}.in"))
    rows += [(n + k, *rows[k][1:]) for k in range(12)] + [(n + 20 + k, "Iron Gym", 77.5, 12.8, None, None) for k in range(6)]
    return rows + [(900, None, 77.5, 12.8, None, None), (901, None, 77.5, 12.8, None, None), (902, "iron gym", None, None, None, None), (903, "", 77.5, 12.8, None, None), (904, "", 77.5, 12.8, None, None)]


def probability(a, b, cell):
    if a[4] is not None and a[4] == b[4]:
        return 0.95, True
    if a[5] is not None and a[5] == b[5]:
        return 0.92, True
    if a[1] is None or b[1] is None or cell[a[0]] is None or cell[a[0]] != cell[b[0]]:
        return None, False
    d = math.hypot((a[2] - b[2]) * 111_000 * 0.98, (a[3] - b[3]) * 111_000)
    place = 1.0 if d <= 30 else 0.75 if d <= 80 else 0.4 if d <= 200 else 0.0
    return min(1.0, 0.55 * token_sort(a[1], b[1]) + 0.45 * place), False


@pytest.mark.parametrize("seed, few", [(0, 64), (1, 3)])
def test_link_counts_and_clusters(spark, monkeypatch, seed, few):
    monkeypatch.setattr(blocks, "FEW", few)
    rows = entities_of(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    cell = {r["id"]: r["c"] for r in df.select("id", geo.geohash(F.col("lon"), F.col("lat"), 7).alias("c")).collect()}
    norm = {r["id"]: r["n"] for r in df.select("id", entities.text.business_name(F.col("name")).alias("n")).collect()}
    plain = [(i, norm[i], *rest) for i, _, *rest in rows]
    shared, match, parent = dict.fromkeys(cell, 0), dict.fromkeys(cell, 0), {i: i for i in cell}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(plain):
        for b in plain[x + 1 :]:
            p, sure = probability(a, b, cell)
            if p is not None and p >= 0.85:
                for i in (a[0], b[0]):
                    (shared if sure else match)[i] += 1
                lo, hi = sorted((find(a[0]), find(b[0])))
                parent[hi] = lo
    got = {r["id"]: (r["n_shared"], r["n_match"]) for r in blocks.link_counts(df).collect()}
    assert got == {i: (shared[i], match[i]) for i in cell}
    assert sum(match.values()) > 40 and sum(shared.values()) > 40
    of = {r["id"]: r["cluster"] for r in entities.clusters(df, entities.match_links(df)).collect()}
    assert of == {i: find(i) for i in cell}
    bands = {r["band"]: r["n"] for r in blocks.bands(df).collect()}
    assert bands["shared"] == sum(shared.values()) // 2 and bands["match"] == sum(match.values()) // 2


def test_partners(spark):
    r = random.Random(3)
    rows = [(i, *[r.choice(["a", "b", "c", None]) for _ in range(3)]) for i in range(120)] + [(200 + i, "hot", None, None) for i in range(50)]
    got = {x["id"]: x["n_partners"] for x in blocks.partners(spark.createDataFrame(rows, "id long, p string, q string, r string"), {k: F.col(k) for k in "pqr"}).collect()}
    meets = lambda a, b: any(x is not None and x == y for x, y in zip(a[1:], b[1:], strict=True))
    assert got == {a[0]: sum(a[0] != b[0] and meets(a, b) for b in rows) for a in rows}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert blocks.link_counts(none).collect() == [] and blocks.bands(none).collect() == []


def test_every_pair_can_be_read_back(spark):
    """The unexpanded forms hold each pair of a block, with its probability: as many as there are, and the same."""
    rows = entities_of(2)
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {"phone": F.col("phone"), "domain": F.col("domain"), "cell": geo.geohash(F.col("lon"), F.col("lat"), 7)}
    cell = {r["id"]: r["c"] for r in df.select("id", keys["cell"].alias("c")).collect()}
    norm = {r["id"]: r["n"] for r in df.select("id", entities.text.business_name(F.col("name")).alias("n")).collect()}
    plain = [(i, norm[i], *rest) for i, _, *rest in rows]
    of = {r["id"]: [r[f"{k}_of"] for k in keys] for r in blocks.blocks_of(df, keys).collect()}
    kinds = {}
    for r in blocks.pair_scores(df).collect():
        kinds.setdefault(r["kind"], {})[(r["a"], r["b"]) if r["kind"] == "pair" else r["b"]] = r["probability"] if r["kind"] == "pair" else r["a"]
    phone, domain, place, pair = (kinds[k] for k in ("phone", "domain", "place", "pair"))
    for x, a in enumerate(plain):
        for b in plain[x + 1 :]:
            i, j = a[0], b[0]
            met = any(p is not None and p == q for p, q in zip(of[i], of[j], strict=True))
            assert met == (a[4] is not None and a[4] == b[4] or a[5] is not None and a[5] == b[5] or cell[i] is not None and cell[i] == cell[j])
            same = next((p for of_, p in ((phone, 0.95), (domain, 0.92), (place, 1.0)) if i in of_ and of_[i] == of_.get(j)), None)
            if same is None and i in place and j in place:
                same = pair.get((min(place[i], place[j]), max(place[i], place[j])))
            want = probability(a, b, cell)[0]
            assert (same is None) == (want is None) and (want is None or abs(same - want) < 1e-9), (a, b)


def test_rows_of_one_name_and_place_are_linked_without_their_pairs(spark):
    """Phones part them into as many classes; every row is linked to one of them all the same."""
    from cartoflow.resolve.blocks import name_links
    from cartoflow.resolve.entities import clusters, match_links

    rows = spark.createDataFrame([(i, "Iron Gym", 77.5, 12.9, f"+9160000{i:05}" if i % 4 else None, f"d{i % 7}.in" if i % 3 else None) for i in range(60)] + [(60, "Iron Gyms", 77.5, 12.9, None, None), (61, "City Bakery", 77.5, 12.9, None, None)], "id long, name string, lon double, lat double, phone string, domain string")
    assert name_links(rows).count() == 60  # 59 rows with the first, and one pair of places
    assert {r["id"]: r["cluster"] for r in clusters(rows, match_links(rows)).collect()} == {i: 0 for i in range(61)} | {61: 61}
