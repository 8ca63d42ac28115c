"""The ladder rung by rung, and close names against all pairs."""

import random

from cartoflow.functions.fuzzy import token_set
from cartoflow.operators import ladder

REQUEST = "request_id long, locality string, city string, state string, raw_text string, lat double, lon double, radius_m double, max_results int"
ANSWER = "key string, display_name string, lon double, lat double, boundary_kind string, buffer_m int, geo_confidence double"


def test_close_names(spark):
    r = random.Random(6)
    words = ["indiranagar", "koramangala", "hsr", "layout", "stage", "second", "block", "jayanagar", "road", "mg", "white", "field"]
    known = sorted({" ".join(r.sample(words, r.randrange(1, 4))) for _ in range(80)})
    asked = [" ".join(r.sample(w.split(), len(w.split()))) if r.random() < 0.5 else w[: len(w) // 2] + w[len(w) // 2 + 1 :] for w in known] + ["nowhere", ""]
    got = {(x["a"], x["b"]) for x in ladder.close_names(spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(b,) for b in known], "b string")).collect()}
    assert got == {(a, b) for a in set(asked) for b in known if a and token_set(a, b) >= 0.85}


def test_rungs(spark):
    key = lambda loc, city, state="": spark.range(1).select(ladder.cache_key(*[ladder.F.lit(x) for x in (loc, city, state, "India")])).first()[0]
    rows = [
        (1, "Here", "Pune", None, None, 18.5, 73.8, 750.0, 10),
        (2, None, "blr", None, None, None, None, None, 10),  # an alias of a city of the list
        (3, "Indiranagr", "Bengaluru", None, None, None, None, None, 10),  # a typo
        (4, "Indiranagar", "Chennai", None, None, None, None, None, 100),  # the same name in another city
        (5, "hsr", None, None, None, None, None, None, 100),
        (6, "Known Lately", None, None, None, None, None, None, 10),
        (7, "Known Once", None, None, None, None, None, None, 10),
        (8, None, None, None, "A Division", None, None, None, 1000),
        (9, None, None, None, None, None, None, None, 1000),
        (10, "Known Long Ago", None, None, None, None, None, None, 10),
    ]
    aliases = [("BLR", None, "Bengaluru", "Karnataka"), ("hsr", "HSR Layout", "Bengaluru", "Karnataka")]
    seeds = [(0, "Bengaluru", "Karnataka", "Indiranagar", 77.64, 12.97, True), (1, "Bengaluru", "Karnataka", "HSR Layout", 77.63, 12.91, False), (2, "Chennai", "Tamil Nadu", "Indira Nagar", 80.25, 12.99, True)]
    answer = ("kept", 1.0, 2.0, "admin_polygon", None, 0.5)
    recent = [(key("Known Lately", ""), *answer, 100), (key("Known Long Ago", ""), *answer, 5000)]
    got = ladder.resolved(
        spark.createDataFrame(rows, REQUEST), spark.createDataFrame(aliases, "alias string, locality string, city string, state string"), spark.createDataFrame(recent, ANSWER + ", age_s int"),
        spark.createDataFrame(seeds, "position long, city string, state string, locality string, lon double, lat double, boxed boolean"), spark.createDataFrame([(key("Known Once", ""), *answer)], ANSWER),
        spark.createDataFrame([("a division", 5.0, 6.0, 0.8)], "name string, lon double, lat double, confidence double"),
    ).collect()
    out = {r["request_id"]: tuple(r)[1:] for r in got}
    assert len(got) == 10 and out[1] == ("coordinates", "Here, Pune, India", 73.8, 18.5, "buffered_point", 750, 1.0)
    assert out[2] == ("seed_city", "Bengaluru, Karnataka, India", 77.64, 12.97, "admin_polygon", None, 0.95)
    assert out[3] == ("seed_area", "Indiranagar, Bengaluru, Karnataka, India", 77.64, 12.97, "admin_polygon", None, 0.92)
    assert out[4][0] == "seed_area" and out[4][2] == 80.25
    assert out[5] == ("seed_area", "HSR Layout, Bengaluru, Karnataka, India", 77.63, 12.91, "buffered_point", 5000, 0.96)
    assert (out[6][0], out[7][0], out[8][0], out[9][0], out[10][0]) == ("recent", "stored", "division", "default", "default")
    assert out[8][2:4] == (5.0, 6.0) and out[9][5] == 10_000


def test_close_names_of_one_common_word(spark, monkeypatch):
    """Names that all share a word: only what can be close is measured by the join of words."""
    from cartoflow.functions import fuzzy

    known = [f"Area {i * 7919 % 100_003:05d}{i * 104_729 % 99_991:05d}" for i in range(120)] + ["MG Road", "Old MG Road area"]
    asked = [x[:8] + x[9:] for x in known[:60]] + ["road mg", "area", "old road"]
    measured = []
    by_letters = ladder.token_sets
    monkeypatch.setattr(ladder, "token_sets", lambda least: measured.append(least) or by_letters(least))
    got = {(x["a"], x["b"]) for x in ladder.close_names(spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(b,) for b in known], "b string")).collect()}
    assert got == {(a, b) for a in asked for b in known if fuzzy.token_set(a.lower(), b.lower()) >= ladder.CLOSE - 1e-9} and measured
