"""Functions and rules on rows whose results are known."""

import random

import pytest
from pyspark.sql import functions as F

from cartoflow.evaluate import metrics as M
from cartoflow.functions import contact, fuzzy, geo, stats, text
from cartoflow.operators import relational as R
from cartoflow.operators.components import components
from cartoflow.quality import scoring as S
from cartoflow.relevance import cascade as C
from cartoflow.relevance.dictionary import Concept, resolve
from cartoflow.resolve import entities as E
from cartoflow.store.shared import spool


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw", ["+91 98765 43210", "09876543210", "9876543210"])
def test_phone(spark, raw):
    assert one(spark, contact.phone_e164(F.col("p")), p=raw) == "+919876543210"


@pytest.mark.parametrize("url,want", [("https://www.cult.fit/gyms/x", "cult.fit"), ("http://goldsgym.in:80/index.html", "goldsgym.in"), ("nodot", None), ("https://www.williampenn.net/store", "williampenn.net")])
def test_domain(spark, url, want):
    assert one(spark, contact.domain(F.col("u")), u=url) == want


def test_names_and_words(spark):
    assert one(spark, text.business_name(F.col("n")), n="Archies Gift Shoppe Pvt Ltd") == "archies gift shoppe"
    assert one(spark, text.sanitized(F.col("n")), n="  Foo_bar=1 & “Ünï”​ ") == "foo_bar 1 ünï"
    assert one(spark, text.stem(F.col("w")), w="bakeries") == "bakery" and one(spark, text.stem(F.col("w")), w="glass") == "glass"
    assert one(spark, text.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a b", "b c"] and one(spark, text.bigrams(F.array(F.lit("a")))) == []
    assert one(spark, text.nfkc("n"), n="ﬁ①") == "fi1" and one(spark, text.taxonomy_text(F.col("n")), n="Café-Bar!") == "cafe-bar"


def test_fuzzy():
    assert fuzzy.lcs_length("kitten", "sitting") == 4 and fuzzy.indel_ratio("", "") == 1
    assert fuzzy.token_sort("pooja store", "store pooja") == 1 and fuzzy.token_set("a b", "a b c") == 1
    assert round(fuzzy.jaro_winkler_of("pooja", "puja"), 3) == 0.805 and round(fuzzy.jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert fuzzy.partial("gym", "the gym shop") == 1


def test_public_urls(spark):
    for url, ok in (("https://x.in/a", True), ("ftp://x.in", False), ("http://127.0.0.1/", False), ("http://10.2.3.4", False), ("http://172.20.0.1", False), ("http://localhost/x", False), ("http://a.internal/", False), ("http://8.8.8.8/", True), ("http://169.254.169.254/", False)):
        assert one(spark, contact.public_url(F.col("u")), u=url) is ok, url


def test_geo(spark):
    assert one(spark, geo.geohash(F.lit(77.641), F.lit(12.915))) == "tdr1qz0"
    block = one(spark, geo.geohash_block(F.lit(77.641), F.lit(12.915)))
    assert len(block) == 9 and "tdr1qz0" in block
    assert round(one(spark, geo.flat_m(F.lit(77.641), F.lit(12.915), F.lit(77.6412), F.lit(12.9152))), 1) == 31.1
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    where = lambda x, y, rule="gate": one(spark, geo.boundary(F.lit(x), F.lit(y), ring, rule))
    assert (where(0.5, 0.5), where(1.001, 0.5), where(1.1, 0.5)) == ("inside", "edge", "outside")
    assert where(1.0, 0.5, "verify") and not where(1.0005, 0.5, "verify") and where(1.0005, 0.5, "web")


def test_stats(spark):
    w = one(spark, stats.wilson(F.lit(45), F.lit(50)))
    assert (round(w["low"], 4), round(w["high"], 4)) == (0.7864, 0.9565)
    assert tuple(one(spark, stats.wilson(F.lit(0), F.lit(0)))) == (0.0, 1.0)
    assert one(spark, stats.fused_rank(F.lit(1), F.lit(1))) == 1.0 and one(spark, stats.chapman(F.lit(10), F.lit(0), F.lit(0))) is None
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.4, 0), (0.2, 0)], "p double, y int")
    assert M.calibration_error(rows, F.col("p"), F.col("y")).first()["ece"] == pytest.approx(0.3)
    assert rows.agg(M.kappa(F.lit(1), F.lit(1)).alias("k")).first()["k"] == 1.0


def test_simhash(spark):
    a = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = spark.createDataFrame([(1, a), (2, a.replace("today", "tonight")), (3, "entirely unrelated words about finance and market prices going down"), (4, None)], "id int, t string")
    h = {r["id"]: r["simhash"] for r in text.simhash64(rows, "t", "id").collect()}
    apart = lambda x, y: bin((h[x] ^ h[y]) & (2**64 - 1)).count("1")
    assert apart(1, 2) < apart(1, 3) and apart(1, 3) > 10 and h[4] == 0


POOJA = Concept("pooja_store", labels=("pooja store",), strong=("pooja", "agarbatti"), medium=("brass",), defining=("pooja_store", "religious_goods"), incompatible=("shoe_store",), veto=("footwear", "taxi"), incompatible_brands=("william penn",))


@pytest.mark.parametrize(
    "name,categories,extra,want",
    [
        ("Sri Balaji Pooja Store", ["pooja_store"], {}, ("accepted", None)),
        ("Sri Balaji Pooja Store", [], {}, ("review", "uncertain_llm_disabled")),
        ("Divine Footwear", ["shoes"], {}, ("rejected", "veto_term")),
        ("Divine Footwear", ["shoe_store"], {}, ("rejected", "incompatible_category")),
        ("Pooja Footwear", ["shoe_store"], {}, ("review", "uncertain_llm_disabled")),
        ("Pens", ["gift"], {"brand": "William Penn"}, ("rejected", "incompatible_brand")),
        ("Pooja Store", ["pooja_store"], {"operating_status": "permanently_closed"}, ("rejected", "closed")),
        ("Sri Stores", [], {}, ("rejected", "low_evidence")),
    ],
)
def test_cascade(spark, name, categories, extra, want):
    row = {"name": name, "brand": None, "operating_status": None, **extra}
    df = spark.createDataFrame([(name, categories, row["brand"], row["operating_status"], 77.75, 12.97)], "name string, categories array<string>, brand string, operating_status string, lon double, lat double")
    r = C.decided(df, POOJA).first()
    assert (r["outcome"], r["code"]) == want


def test_scores_without_models(spark):
    df = spark.createDataFrame([("Brass House", ["pooja_store"]), ("plain", ["x"]), ("Pooja", ["x"]), ("Sri Store", ["x"])], "name string, categories array<string>")
    card = Concept("p", strong=("pooja",), defining=("pooja_store",))
    got = {r["name"]: round(r["p"], 4) for r in C.scored(C.features(df, card), card).collect()}
    assert got == {"Brass House": 0.9707, "plain": 0.5744, "Pooja": 0.7685, "Sri Store": 0.0759}


def test_boundary_gate(spark):
    ring = [(77.0, 12.0), (78.0, 12.0), (78.0, 13.0), (77.0, 13.0)]
    df = spark.createDataFrame([("a", 77.5, 12.5), ("b", 78.001, 12.5), ("c", 79.0, 12.5)], "name string, lon double, lat double").withColumn("categories", F.array(F.lit("pooja_store")))
    got = {r["name"]: (r["reason_code"], r["edge_case"]) for r in C.hard_gates(df, POOJA, ring).collect()}
    assert got == {"a": (None, False), "b": (None, True), "c": ("outside_boundary", False)}


def test_keywords():
    assert resolve("Pooja Stores", [POOJA])[2] in ("exact", "alias") and resolve("poja store", [POOJA])[2] == "fuzzy" and resolve("???", [POOJA])[0] is None


def test_two_sources_become_one_entity(spark):
    rows = spark.createDataFrame(
        [(1, "overture", "Sri Balaji Pooja Store", 77.641, 12.915, "+918025551234", None), (2, "osm", "Sri Balaji Pooja Store", 77.6412, 12.9152, "08025551234", None), (3, "osm", "Far Shop", 77.9, 12.5, None, None)],
        "id long, source string, name string, lon double, lat double, phone string, domain string",
    )
    scores = E.pair_scores(E.candidate_pairs(rows), rows)
    assert [(r["a"], r["b"], round(r["probability"], 4)) for r in scores.collect()] == [(1, 2, 0.8875)]
    out = {r["cluster"]: r for r in E.golden_records(rows, E.clusters(rows, scores)).collect()}
    assert set(out) == {1, 3} and out[1]["canonical_name"] == "Sri Balaji Pooja Store" and out[1]["independent_source_count"] == 2 and out[1]["source_ids"] == ["osm:2", "overture:1"]
    near = {(r["a"], r["b"]) for r in E.candidate_pairs(rows, neighbours=True).collect()}
    assert near >= {(1, 2)}


def test_clusters_are_transitive(spark):
    rows = spark.range(30).toDF("id")
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(0, 20)] + [(25, 26, 0.5)], "a long, b long, probability double")
    got = {r["id"]: r["cluster"] for r in E.clusters(rows, pairs).collect()}
    assert got == {i: 0 if i <= 20 else i for i in range(30)}


def test_components_in_few_steps(spark):
    steps = []

    def step(df):
        steps.append(1)
        return spool(df)

    n = 1000
    line = spark.range(n - 1, numPartitions=2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(line, step).collect()} == {0} and len(steps) <= 15
    r = random.Random(0)
    ids = r.sample(range(10**6), 300)
    mixed = spark.createDataFrame([*zip(ids[:149], ids[1:150]), *zip(ids[150:], ids[151:]), (ids[0], ids[0])], "a long, b long")
    got = {x["node"]: x["root"] for x in components(mixed).collect()}
    assert got == {x: min(part) for part in (ids[:150], ids[150:]) for x in part}
    assert components(mixed.limit(0)).count() == 0


def test_links_make_the_clusters_of_pairs(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(i, r.choice(["Iron Gym", "Iron Gim", "Royal Hotel"]), 77 + r.randrange(9) / 1e4, 12.0, r.choice([None, None, f"p{r.randrange(9)}"]), r.choice([None, None, f"d{r.randrange(9)}"])) for i in range(60)], "id long, name string, lon double, lat double, phone string, domain string")
    every = E.pair_scores(E.candidate_pairs(rows), rows)
    assert E.clusters(rows, every).orderBy("id").collect() == E.clusters(rows, E.match_links(rows)).orderBy("id").collect()


def test_suppression_never_multiplies(spark):
    b = spark.createDataFrame([(1, ["p1", "p2"], ["e"], "d.in"), (2, None, None, None), (3, [], [], "x.in")], "id int, phones array<string>, emails array<string>, domain string")
    s = spark.createDataFrame([("p1", None, None), ("p2", None, None), (None, None, "d.in"), (None, "zz", None)], "phone string, email string, domain string")
    assert [r["id"] for r in R.suppressed_ids(b, s).collect()] == [1]


def test_one_predicate_for_list_counts_and_export(spark):
    res = spark.createDataFrame([(1, i, i, d, False) for i, d in enumerate(["accepted"] * 3 + ["review"] * 2 + ["rejected"] * 2)], "run_id int, business_id int, rank int, decision string, is_new boolean")
    bus = spark.createDataFrame([(i, f"n{i}", ["p"] if i % 2 else [], None, None, 0.5) for i in range(7)], "id int, name string, phones array<string>, emails array<string>, domain string, confidence double")
    f = R.Selection(of_run=1, in_state="accepted")
    counts = {r["decision"]: r["count"] for r in R.leads(res, bus, f, with_state=False).groupBy("decision").count().collect()}
    assert counts == {"accepted": 3, "review": 2, "rejected": 2} and R.leads(res, bus, f).count() == counts["accepted"]
    assert R.leads(res, bus, R.Selection(reachable_by=("phones",))).count() == 3 and R.leads(res, bus, R.Selection(name_has="N_")).count() == 0
    assert R.next_cursor(R.page(res, 3), 3).first()["next_cursor"] == 2 and R.next_cursor(R.page(res, 30), 30).first()["next_cursor"] is None


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0.9, "V"), (2, "b", 0.1, "U")], "id int, name string, confidence double, tier string")
    new = spark.createDataFrame([(1, None, 0.5, "L"), (2, "B", 0.1, "L"), (3, "c", 0.2, "U")], "id int, name string, confidence double, tier string")
    got = sorted(tuple(r) for r in R.upsert(old, new, ["id"], {"name": "fill", "confidence": "greatest", "tier": "with:confidence"}).collect())
    assert got == [(1, "a", 0.9, "V"), (2, "B", 0.1, "L"), (3, "c", 0.2, "U")]


def test_near_pairs_are_whole(spark):
    import math
    import random

    r = random.Random(0)
    points = [(i, 77.6 + r.random() / 100, 12.9 + r.random() / 100) for i in range(80)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")

    def metres(p, q):
        a = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    want = {(p[0], q[0]) for p in points for q in points if metres(p, q) <= 120}
    assert {(x["left_id"], x["right_id"]) for x in R.near_pairs(df, df, 120.0).collect()} == want


def test_scoring(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, "+918025551234", "a@b.in", "b.in", True, 2, "operational", "12 Main Road, X"), (2, 0.0, 0.0, "+919876543210", None, None, None, 1, "permanently_closed", None)], "id int, lon double, lat double, phone string, email string, website string, website_ok boolean, independent_source_count int, operating_status string, address string")
    got = {r["id"]: (r["confidence"], r["tier"]) for r in S.scored(e, S.checks(e)).collect()}
    assert got == {1: (0.99, "Verified"), 2: (0.1, "Unverified")}
    with pytest.raises(ValueError):
        S.validate_weights({"phone_valid": 1})


BASIS = {"critical_error": False, "cancelled": False, "accepted": 5, "target": 30, "budget_exhausted": False, "any_failed": False, "candidates_seen": 50, "raw_count": 0, "new_businesses": 5, "matched_existing": 0, "reached_final_rung": False, "last_rung_new": 1}


@pytest.mark.parametrize(
    "change,want",
    [
        ({"critical_error": True}, "failed"), ({"cancelled": True}, "cancelled"), ({"accepted": 30}, "target_met"), ({"budget_exhausted": True}, "budget_exhausted"), ({"any_failed": True}, "partial_sources"),
        ({"accepted": 0, "candidates_seen": 0, "raw_count": 9}, "keyword_plan_matched_nothing"), ({"accepted": 0, "candidates_seen": 0}, "no_candidates_found"), ({"new_businesses": 0, "matched_existing": 4}, "no_new_leads"),
        ({"accepted": 1, "candidates_seen": 500}, "low_relevance"), ({"reached_final_rung": True, "last_rung_new": 0}, "region_exhausted"), ({}, "low_relevance"),
    ],
)
def test_completion(spark, change, want):
    assert one(spark, S.completion_reason({k: F.lit(v) for k, v in (BASIS | change).items()})) == want


def test_imports(spark, tmp_path):
    from cartoflow.sources.imports import import_candidates, read_import

    (tmp_path / "x.csv").write_text("﻿id,Name,longitude,lat\n1,A,77.5,12.9\n2,B,zz,12.9\n3,C,0,0\n4,,77.5,12.9\n", encoding="utf-8")
    out = import_candidates(read_import(spark, f"{tmp_path}/x.csv")).collect()
    assert [(r["source_record_id"], r["name"], r["lon"]) for r in out] == [("x.csv:1", "A", 77.5)]


def test_places_scan(spark, tmp_path):
    from cartoflow.sources.places import flatten_places, scan_places

    box = lambda x: (x, x, 12.9, 12.9)
    rows = [("1", ("A",), ("gym", ["sports"]), [("meta", "CC0")], box(77.5), None), ("2", ("B",), (None, None), [], box(77.6), "permanently_closed"), ("3", (None,), ("x", None), [], box(77.5), "open"), ("4", ("D",), ("x", None), [], box(99.0), None)]
    schema = "id string, names struct<primary:string>, taxonomy struct<primary:string,hierarchy:array<string>>, sources array<struct<dataset:string,license:string>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, operating_status string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/p")
    out = flatten_places(scan_places(spark, f"{tmp_path}/p", (77.0, 12.0, 78.0, 13.0))).collect()
    assert [(r["source_record_id"], r["categories"], r["lon"]) for r in out] == [("1", ["gym", "sports"], 77.5)]
    spark.range(1).write.parquet(f"{tmp_path}/q")
    with pytest.raises(ValueError):
        scan_places(spark, f"{tmp_path}/q", (0, 0, 1, 1))


def test_whole_pages_are_matched(spark, tmp_path):
    from cartoflow.plans.registry import QUERIES

    late = lambda n: "<p>" + "x" * n + "</p> The of and"
    rows = [(1, "u", late(10)), (2, "u", late(900)), (3, "u", late(4800)), (4, "u", late(6000))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["ver_02"](spark, str(tmp_path))
    assert {r["page_id"]: r["named"] for r in found.collect()} == {1: True, 2: True, 3: True, 4: False}


def test_appends_are_counted(spark, tmp_path):
    from cartoflow.sources.sinks import append_checked

    path = f"{tmp_path}/t"
    append_checked(spark.range(3).toDF("a"), "t", path)
    assert append_checked(spark.range(4).toDF("a"), "t", path).count() == 7


def test_streams(spark, tmp_path):
    from cartoflow.streaming import events as V

    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "view") for i in range(120)], "event_id long, ts string, user_id int, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "cast(event_id as double) value")
    rows.write.parquet(f"{tmp_path}/in/events.parquet")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/events.parquet")
    seen = []
    V.upsert_batches(V.counters(stream()), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/c1").awaitTermination()
    assert {r["event_type"]: r["n"] for r in seen} == {"view": 120}
    for k, shape in enumerate((V.tumbling, V.sessions, V.once)):
        V.publish(shape(stream()), f"{tmp_path}/o{k}", f"{tmp_path}/s{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o2").count() == 120


def test_near_points_of_copies(spark, monkeypatch):
    """Rows of one point are measured once: no more pairs are measured than there are of distinct points."""
    import random

    r = random.Random(3)
    where = [(77.6 + r.random() / 100, 12.9 + r.random() / 100) for _ in range(12)]
    rows = [(i, *where[i % 12], ["Iron Gym", "gym", "Hotel", None][i % 4]) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double, name string")
    measured = R._near_points(df, df, 120.0).collect()
    assert len(measured) <= 144
    near = {(m["x1"], m["y1"], m["x2"], m["y2"]): m["metres"] for m in measured}
    of = {p[0]: sorted((round(near[p[1], p[2], q[1], q[2]], 6), q[0]) for q in rows if (p[1], p[2], q[1], q[2]) in near) for p in rows}
    got = {}
    for x in R.near_pairs(df, df, 120.0, at_most=7).collect():
        got.setdefault(x["left_id"], []).append((round(x["metres"], 6), x["right_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v[:7] for k, v in of.items()}
    assert {x["id"]: x["n"] for x in R.near_counts(df, df, 120.0).collect()} == {k: len(v) for k, v in of.items()}
    names = {p[0]: (p[3] or "").lower() for p in rows}
    want = {k: min([j for _, j in v if names[k] and names[j] and (names[j] in names[k] or names[k] in names[j])], default=None) for k, v in of.items()}
    assert {x["id"]: x["match_id"] for x in R.near_named(df, df, 120.0).collect()} == {k: v for k, v in want.items() if v is not None}


def test_geohash_neighbours(spark):
    """Integer cells against the letters, at the date line and the poles; repeated ids keep their pairs."""
    rows = [(i, lon, lat) for i, (lon, lat) in enumerate([(179.9999, 10.0), (-179.9999, 10.0), (0.0, 89.9999), (0.0, -89.9999), (77.6, 12.9), (77.6, 12.9), (77.6012, 12.9), (77.609, 12.9), (77.65, 12.9), (None, 1.0)])]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    cells = {x["id"]: (x["c"], x["b"]) for x in df.where("lon IS NOT NULL").select("id", geo.geohash(F.col("lon"), F.col("lat"), 6).alias("c"), geo.geohash_block(F.col("lon"), F.col("lat"), 6).alias("b")).collect()}
    want = sorted((i, j) for i in cells for j in cells if cells[j][0] in cells[i][1])
    assert sorted(map(tuple, geo.geohash_neighbours(df, df, 6).collect())) == want and (0, 1) in want
    twice = df.where("id = 4")
    assert geo.geohash_neighbours(twice.union(twice), df.where("id = 5"), 6).count() == 2
