"""Coordinates, longitude first, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
EDGE_DEG = 150.0 / 111_000.0
# Fixed value: the alphabet of geohashes.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The plane's distance with 111 km a degree, longitudes at 0.98 of that."""
    dx, dy = (lon1 - lon2) * 111_000.0 * 0.98, (lat1 - lat2) * 111_000.0
    return F.sqrt(dx * dx + dy * dy)


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the ring's edges; points on an edge are as the rule has them."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit((x2 - x1) / (y2 - y1)) * (lat - F.lit(y1)) + F.lit(x1))
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def ring_distance(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Distance in degrees from the ring's edges."""
    each = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        length = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / length)) if length else F.lit(0.0)
        each.append(F.sqrt(F.pow(lon - (x1 + t * (x2 - x1)), 2) + F.pow(lat - (y1 + t * (y2 - y1)), 2)))
    return F.least(*each)


def boundary(lon: Column, lat: Column, ring: list[tuple[float, float]], rule: str = "gate") -> Column:
    """Three rules: ``gate`` gives inside, edge (within 150 m) or outside; ``verify`` inside or touching; ``web`` also
    within 0.001 degrees."""
    inside = in_ring(lon, lat, ring)
    if rule == "gate":
        return F.when(inside, "inside").when(ring_distance(lon, lat, ring) <= EDGE_DEG, "edge").otherwise("outside")
    return inside | (ring_distance(lon, lat, ring) <= F.lit(1e-12 if rule == "verify" else 0.001))


def in_bbox(lon: Column, lat: Column, wkt: Column, margin: float = 0.1) -> Column:
    """Within the bounding box of a WKT's coordinates, widened by a share of its sides."""
    xs = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[\d.]+) +(-?[\d.]+)"), 1), lambda x: x.cast("double"))
    ys = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[\d.]+) +(-?[\d.]+)"), 2), lambda x: x.cast("double"))
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    dx, dy = (x2 - x1) * margin, (y2 - y1) * margin
    return lon.between(x1 - dx, x2 + dx) & lat.between(y1 - dy, y2 + dy)


def _cells(lon: Column, lat: Column, precision: int) -> tuple[Column, Column, int, int]:
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    return x, y, nx, ny


def _encoded(x: Column, y: Column, nx: int, ny: int, precision: int) -> Column:
    letters = []
    bit = lambda v, n, i: F.shiftright(v, n - 1 - i).bitwiseAND(F.lit(1))
    for k in range(precision):
        value = F.lit(0)
        for j in range(5 * k, 5 * k + 5):
            value = value * 2 + (bit(x, nx, j // 2) if j % 2 == 0 else bit(y, ny, j // 2))
        letters.append(F.substr(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash(lon: Column, lat: Column, precision: int = 7) -> Column:
    x, y, nx, ny = _cells(lon, lat, precision)
    return _encoded(x, y, nx, ny, precision)


def geohash_block(lon: Column, lat: Column, precision: int = 7) -> Column:
    """The geohashes of the point's cell and its eight neighbours (longitude wraps, latitude ends), distinct."""
    x, y, nx, ny = _cells(lon, lat, precision)
    cells = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            v = y + dy
            cells.append(F.when(v.between(0, (1 << ny) - 1), _encoded(F.pmod(x + dx, F.lit(1 << nx)), v, nx, ny, precision)))
    return F.array_distinct(F.filter(F.array(*cells), lambda c: c.isNotNull()))


def geohash_neighbours(left: DataFrame, right: DataFrame, precision: int = 7) -> DataFrame:
    """(id, other): rows (id, lon, lat) of both sides in one geohash cell or in neighbouring ones, as ``geohash_block`` has it.

    Cells stay numbers, and neighbours are told for distinct cells, not for every row."""

    def placed(rows: DataFrame, name: str, a: str, b: str) -> DataFrame:
        x, y, *_ = _cells(F.col("lon"), F.col("lat"), precision)
        return rows.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("id").alias(name), x.alias(a), y.alias(b))

    bits = 5 * precision
    nx, ny = 1 << (bits + 1) // 2, 1 << bits // 2
    mine, theirs = placed(left, "id", "x", "y"), placed(right, "other", "x2", "y2")
    moved = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    about = mine.select("x", "y").distinct().withColumn("m", moved).select("x", "y", F.pmod(F.col("x") + F.col("m.i"), F.lit(nx)).alias("x2"), (F.col("y") + F.col("m.j")).alias("y2"))
    about = about.where(F.col("y2").between(0, ny - 1)).join(theirs.select("x2", "y2").distinct(), ["x2", "y2"])
    return mine.join(about, ["x", "y"]).select("id", "x2", "y2").join(theirs, ["x2", "y2"]).select("id", "other")


def buffer_ring(lon: Column, lat: Column, metres: Column, corners: int = 32) -> Column:
    """The corners of a regular polygon around a point, east-west scaled by latitude, 111,320 m a degree."""
    r = metres / 111_320.0
    angle = lambda i: i * F.lit(2.0 * 3.141592653589793 / corners)
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct((lon + r * F.cos(angle(i)) / F.cos(F.radians(lat))).alias("x"), (lat + r * F.sin(angle(i))).alias("y")))


def buffer_radius(target: Column, bounds: list[tuple[int, int]], default: int) -> Column:
    """The radius of the first bound that is not under the target."""
    out = F.lit(default)
    for most, radius in sorted(bounds, reverse=True):
        out = F.when(target <= most, F.lit(radius)).otherwise(out)
    return out


def snapped(value: Column, up: bool = False, grid: float = 0.05) -> Column:
    return (F.ceil(value / grid) if up else F.floor(value / grid)).cast("double") * grid


def tile_key(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.substring(F.sha2(F.format_string("%.4f_%.4f_%.4f_%.4f", x1, y1, x2, y2), 256), 1, 16)


def geocode_score(likeness: Column, city_agrees: Column, state_agrees: Column) -> Column:
    """Likeness, at 0.6 where cities differ and 0.8 where states do (null: nothing to compare)."""
    return likeness * F.when(city_agrees == F.lit(False), 0.6).otherwise(1.0) * F.when(state_agrees == F.lit(False), 0.8).otherwise(1.0)


def geo_confidence(likeness: Column, subtype: Column, polygon: Column) -> Column:
    # How much each kind of area counts.
    kinds = {"microhood": 1.0, "neighbourhood": 0.95, "locality": 0.90, "suburb": 0.85, "county": 0.70, "region": 0.50}
    weight = F.lit(0.5)
    for kind, w in kinds.items():
        weight = F.when(subtype == kind, w).otherwise(weight)
    return F.least(F.lit(1.0), likeness * weight + F.when(polygon, 0.1).otherwise(0.0))
