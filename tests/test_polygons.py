"""Points in shapes against every edge of every shape: holes, parts, borders, sizes from metres to continents, bad input."""

import math
import random

import pytest

from cartoflow.operators import polygons


def ring(r, cx, cy, size, n):
    return [(cx + size * (0.5 + r.random() / 2) * math.cos(2 * math.pi * i / n), cy + size * (0.5 + r.random() / 2) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def text(parts):
    one = lambda g: "(" + ", ".join(f"{x!r} {y!r}" for x, y in g + g[:1]) + ")"
    each = ["(" + ", ".join(map(one, p)) + ")" for p in parts]
    return f"POLYGON {each[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(each)})"


def brute(x, y, rings, reach=polygons.EDGE_DEG):
    odd, away = False, math.inf
    for g in rings:
        for (x1, y1), (x2, y2) in zip(g, g[1:] + g[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
            dx, dy = x2 - x1, y2 - y1
            s = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            away = min(away, math.hypot(x - x1 - s * dx, y - y1 - s * dy))
    return "inside" if odd and away > 1e-12 else "edge" if away <= reach else None, odd or away <= 1e-12, odd or away < 0.001


@pytest.fixture(scope="module")
def world():
    r, shapes, points = random.Random(2), {}, []
    for i in range(30):
        size, cx, cy = 10 ** r.uniform(-3, 1), r.uniform(-100, 100), r.uniform(-50, 50)
        parts = [[ring(r, cx, cy, size, r.choice([3, 5, 8, 400])), ring(r, cx, cy, size / 5, 4)], [ring(r, cx + 3 * size, cy, size, 5)]]
        shapes[i] = (parts if i % 2 else parts[:1], cx, cy, size)
    for k in range(2000):
        of = r.randrange(30)
        parts, cx, cy, size = shapes[of]
        x, y = r.choice(r.choice(parts)[0]) if k % 5 == 0 else (cx + r.uniform(-1.5, 5) * size, cy + r.uniform(-1.5, 1.5) * size)
        near = 0.002 if k % 10 == 0 else 0  # else corners are hit exactly
        points.append((k, x + r.uniform(-near, near), y + r.uniform(-near, near), of))
    return {i: [g for p in s[0] for g in p] for i, s in shapes.items()}, [(i, text(s[0])) for i, s in shapes.items()], points


BAD = [(90, None), (91, "POLYGON((1 2, x y, 3 4))"), (92, "POINT(1 2)"), (93, "POLYGON EMPTY"), (None, None)]


def test_located(spark, world):
    rings, shapes, points = world
    got = polygons.located(spark.createDataFrame([*points, (9000, None, 1.0, 0), (9001, 1.0, float("nan"), 0)], "id long, lon double, lat double, of long"), spark.createDataFrame(shapes + BAD, "id long, wkt string"))
    want = {(k, i, *b) for k, x, y, _ in points for i, g in rings.items() for b in [brute(x, y, g)] if any(b)}
    rows = [tuple(r) for r in got.select("id", "shape_id", "gate", "verify", "web").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r[2] for r in rows} == {"inside", "edge"}


def test_judged(spark, world):
    rings, shapes, points = world
    extra = [(9000, None, 1.0, 0), (9001, 5.0, 5.0, 90), (9002, 5.0, 5.0, None), (9003, 170.0, 80.0, 0)]
    got = polygons.judged(spark.createDataFrame(points + extra, "id long, lon double, lat double, of long"), spark.createDataFrame(shapes + BAD, "id long, wkt string"), "of")
    want = {k: brute(x, y, rings[of])[0] or "outside" for k, x, y, of in points} | {9000: None, 9001: None, 9002: None, 9003: "outside"}
    rows = got.collect()
    assert len(rows) == len(want) and {r["id"]: r["gate"] for r in rows} == want


def test_inner_cells_have_no_edges(spark, world):
    """Most cells of a large shape need no test, and the others look at a few of its edges."""
    many = [(10 * math.cos(i / 2000 * math.tau), 10 * math.sin(i / 2000 * math.tau)) for i in range(2000)]
    cells = polygons.cover(spark.createDataFrame([(1, text([[many]]))], "id long, wkt string")).selectExpr("count_if(edges IS NULL) AS inner", "avg(size(edges)) AS edges").first()
    assert cells["inner"] > 400 and cells["edges"] < 300


def test_nothing(spark):
    points, shapes = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lon double, lat double"), spark.createDataFrame(BAD, "id long, wkt string")
    assert polygons.located(points, shapes).collect() == [] and polygons.located(points.limit(0), shapes).collect() == []


def test_copies_are_held_against_each_other_once(spark, monkeypatch):
    """Many rows of one point and of one shape: each of their pairs comes, the geometry is looked at once for each point."""
    looked, spool = [], polygons.spool

    def counted(df):
        out = spool(df)
        if "gate" in df.columns:
            looked.append(out.count())
        return out

    monkeypatch.setattr(polygons, "spool", counted)
    points = spark.createDataFrame([(i, 0.5 + i % 2 * 5, 0.5) for i in range(40)], "id long, lon double, lat double")
    shapes = spark.createDataFrame([(k, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))") for k in range(7)] + [(90, None)], "id long, wkt string")
    got = sorted((r["id"], r["shape_id"], r["gate"]) for r in polygons.located(points, shapes).collect())
    assert got == sorted((i, k, "inside") for i in range(0, 40, 2) for k in range(7)) and looked == [1]
