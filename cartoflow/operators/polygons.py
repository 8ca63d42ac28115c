"""Points located in a table of shapes: both sides are tables of any size, and meet by cells.

A shape is WKT, POLYGON or MULTIPOLYGON, with holes and parts.  It is covered by cells of a level of its own, so that its
bounding box is SIDE cells wide (more where it has many edges).  A cell that no edge comes near is inside or outside as a
whole, which one scan line a row of cells tells; the others carry the edges that a point in them must be held against: those
that its ray to the right can cross, and those within ``reach``.  Points look up their cell at each level in use, an equality
join; no point is held against a shape whose cells it is not in, and no edge is looked at for points well inside.

Inside is the even-odd rule over all rings, so holes are out and parts are in.  Points within TOUCH of an edge touch it.
Shapes that cross 180 degrees are to be cut there.  Malformed or null WKT: no cells, so nothing is in it.  Null coordinates:
in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions.geo import EDGE_DEG
from cartoflow.store.shared import spool

#: Cells along a bounding box, at least and at most; between them the root of the number of edges.
SIDE, MOST_SIDE = 16, 256
LEVELS = 24
TOUCH = 1e-12
WEB_DEG = 0.001


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def edges_of(shapes: DataFrame, id_: str = "id", wkt: str = "wkt") -> DataFrame:
    """Rows (shape_id, x1, y1, x2, y2), an edge each; rings are closed where they are not."""
    rings = shapes.where(F.upper(F.ltrim(wkt)).rlike("^(MULTI)?POLYGON")).select(F.col(id_).alias("shape_id"), F.posexplode(F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), 1)).alias("ring", "text"))
    point = lambda s: F.split(F.trim(s), " +")
    points = F.transform(F.split("text", ","), lambda s: F.struct(F.get(point(s), F.lit(0)).try_cast("double").alias("x"), F.get(point(s), F.lit(1)).try_cast("double").alias("y")))
    rings = rings.withColumn("p", points).where(F.forall("p", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    n = F.size("p")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", (i + 1) % n).alias("b")))
    flat = rings.select("shape_id", F.explode(pairs).alias("e")).select("shape_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return flat.where("x1 <> x2 OR y1 <> y2")


def cover(shapes: DataFrame, reach: float = EDGE_DEG, id_: str = "id", wkt: str = "wkt") -> DataFrame:
    """Rows (shape_id, level, row, col, edges): cells that are inside (edges null), or that edges come near."""
    edges = edges_of(shapes, id_, wkt)
    box = edges.groupBy("shape_id").agg(F.count("*").alias("n"), *[F.min(F.least(f"{c}1", f"{c}2")).alias(f"{c}_lo") for c in "xy"], *[F.max(F.greatest(f"{c}1", f"{c}2")).alias(f"{c}_hi") for c in "xy"])
    side = F.greatest(F.lit(float(SIDE)), F.least(F.lit(float(MOST_SIDE)), F.sqrt("n")))
    extent = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"), F.lit(2 * reach))
    box = box.select("shape_id", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(side * 360.0 / extent)))).cast("int").alias("level"))

    edge = F.struct("x1", "y1", "x2", "y2")
    cell = lambda v: F.floor(v / F.col("size")).cast("long")
    placed = edges.join(box, "shape_id").withColumn("size", _size(F.col("level")))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    placed = placed.withColumn("row", F.explode(F.sequence(cell(low - reach), cell(high + reach))))
    # What of the edge is within reach of the row, and the columns that this part comes near.
    bottom, top = F.col("row") * F.col("size") - reach, (F.col("row") + 1) * F.col("size") + reach
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.greatest(low, F.least(high, y)) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(at(bottom), at(top)))
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(at(bottom), at(top)))
    middle = (F.col("row") + 0.5) * F.col("size")
    crosses = (F.col("y1") > middle) != (F.col("y2") > middle)
    placed = placed.withColumns({"cols": F.sequence(cell(left - reach), cell(right + reach)), "cross": F.when(crosses, at(middle))})
    rows = placed.groupBy("shape_id", "level", "row").agg(F.array_distinct(F.flatten(F.collect_list("cols"))).alias("near"), F.sort_array(F.collect_list("cross")).alias("cross"), F.collect_list(edge).alias("edges"))
    rows = rows.withColumn("size", _size(F.col("level")))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("cross") / 2).cast("int")), lambda i: F.struct(F.ceil(F.get("cross", 2 * i) / F.col("size") - 0.5).alias("lo"), F.floor(F.get("cross", 2 * i + 1) / F.col("size") - 0.5).alias("hi")))
    inner = F.flatten(F.transform(F.filter(spans, lambda s: s["lo"] <= s["hi"]), lambda s: F.sequence(s["lo"], s["hi"])))
    rows = rows.withColumn("inner", F.array_except(inner, "near"))
    inside = rows.select("shape_id", "level", "row", F.explode("inner").alias("col"))
    about = rows.select("shape_id", "level", "row", F.explode("near").alias("col"), "edges", "size")
    about = about.select("shape_id", "level", "row", "col", F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("col") * F.col("size") - reach).alias("edges"))
    return about.unionByName(inside, allowMissingColumns=True)


def _odd(x: Column, y: Column, edges: Column) -> Column:
    def crossing(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(edges, crossing)) % 2 == 1


def _away(x: Column, y: Column, edges: Column) -> Column:
    def one(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy)))
        return F.sqrt(F.pow(x - (e["x1"] + t * dx), 2) + F.pow(y - (e["y1"] + t * dy), 2))

    return F.array_min(F.transform(edges, one))


def located(points: DataFrame, shapes: DataFrame, reach: float = EDGE_DEG, id_: str = "id", wkt: str = "wkt") -> DataFrame:
    """Points (with lon, lat) in or near shapes: all their columns, shape_id, gate (``inside``, or ``edge`` within reach),
    verify (inside or touching) and web (also within 0.001 degrees).  A row for each shape that a point is in or near."""
    # Distinct points are held against distinct shapes; rows of either come back by joins at the end.
    drawn = spool(shapes.where(F.col(id_).isNotNull() & F.col(wkt).isNotNull()).select(F.col(id_).alias("shape_id"), F.col(wkt).alias("_wkt")))
    one = spool(drawn.groupBy("_wkt").agg(F.min("shape_id").alias("_shape")))
    members = drawn.join(one, "_wkt").select("shape_id", "_shape")
    cells = spool(cover(one, max(reach, WEB_DEG), "_shape", "_wkt").withColumnRenamed("shape_id", "_shape"))
    levels = F.array(*[F.lit(r[0]) for r in cells.select("level").distinct().collect()]).cast("array<int>")  # LEVELS + 1 at most
    x, y = F.col("_lon"), F.col("_lat")
    looked = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct().withColumn("level", F.explode(levels))
    looked = looked.withColumns({c: F.floor(v / _size(F.col("level"))).cast("long") for c, v in (("row", y), ("col", x))})
    met = looked.join(cells, ["level", "row", "col"])
    met = met.withColumns({"_in": F.when(F.col("edges").isNull(), True).otherwise(_odd(x, y, F.col("edges"))), "_away": _away(x, y, F.col("edges"))})
    away = F.coalesce(F.col("_away"), F.lit(float("inf")))
    met = met.withColumns({"gate": F.when(F.col("_in") & (away > TOUCH), "inside").when(away <= reach, "edge"), "verify": F.col("_in") | (away <= TOUCH), "web": F.col("_in") | (away < WEB_DEG)})
    told = spool(met.where("gate IS NOT NULL OR verify OR web").select("_lon", "_lat", "_shape", "gate", "verify", "web"))
    found = told.join(members, "_shape").drop("_shape")
    return points.join(found, (F.col("lon") == x) & (F.col("lat") == y)).select(*points.columns, "shape_id", "gate", "verify", "web")


def judged(points: DataFrame, shapes: DataFrame, of: str, reach: float = EDGE_DEG, id_: str = "id", wkt: str = "wkt") -> DataFrame:
    """Every point with ``gate`` against the one shape that its column ``of`` names: inside, edge or outside, and null where
    there is no such shape or no point (nothing to hold it against)."""
    # Only cells of the point's own shape count, so the shape is part of the key.
    cells = spool(cover(shapes, reach, id_, wkt).withColumnRenamed("shape_id", of))
    level = cells.groupBy(of).agg(F.first("level").alias("level"))
    looked = points.join(level, of, "left").withColumns({c: F.floor(F.col(v) / _size(F.col("level"))).cast("long") for c, v in (("row", "lat"), ("col", "lon"))})
    met = looked.join(cells.withColumn("_met", F.lit(True)), [of, "level", "row", "col"], "left")
    x, y = F.col("lon"), F.col("lat")
    inner = F.col("_met") & (F.col("edges").isNull() | _odd(x, y, F.col("edges")))
    away = F.coalesce(_away(x, y, F.col("edges")), F.lit(float("inf")))
    gate = F.when(inner & (away > TOUCH), "inside").when(away <= reach, "edge").otherwise("outside")
    return met.select(*points.columns, F.when(F.col("level").isNotNull() & x.isNotNull() & y.isNotNull(), gate).alias("gate"))
