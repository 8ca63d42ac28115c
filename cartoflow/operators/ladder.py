"""Locations resolved by a ladder of tables, in order of trust: the first rung that knows a request answers it.

Aliases are put in first (by locality, else city, else the text as typed; then by locality and by city).  Rungs: ``coordinates``
of the request's own, ``recent`` answers that are not older than a time to live, ``seed_city`` and ``seed_area`` (close names,
typos let through), ``stored`` answers of any age, ``division`` (an equal name), and ``default`` where none of them knows.  Rungs
that ask services over the network are for others to fill: their answers are rows of ``stored``.

Names are close by token-set likeness.  It needs shared words that are most of one name, or enough letters in common: the first
meet by the rarest words of either name, the others are told by their letters in packs, and measured there.  Every rung sees
only what the ones before it have left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.functions import fuzzy, geo
from cartoflow.operators.packs import compared, token_sets
from cartoflow.store.shared import spool

CLOSE, SAME_CITY, COUNTRY = 0.85, 0.70, "India"
#: Radius in metres by the number of results that are wanted; for a locality, and for more.
BOUNDS, DEFAULT_M = ((50, 2_000), (200, 5_000)), 10_000
ANSWER = "tier string, display_name string, lon double, lat double, boundary_kind string, buffer_m int, geo_confidence double"
_FIELDS = [f.split()[0] for f in ANSWER.split(", ")]


def _plain(c: str | Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def close_names(left: DataFrame, right: DataFrame, least: float = CLOSE) -> DataFrame:
    """(a, b, likeness) of two columns ``a`` and ``b`` of names whose token-set likeness is ``least`` or more."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    a = left.select("a").where("a <> ''").distinct()
    b = right.select("b").where("b <> ''").distinct()
    wa, wb = (spool(df.select(c, F.explode(words(c)).alias("word"))) for df, c in ((a, "a"), (b, "b")))

    def telling(df: DataFrame, c: str, other: DataFrame) -> DataFrame:
        """The rarest words of each name: what is left without them is too short to make two names close."""
        counts = other.groupBy("word").agg(F.count("*").alias("df"))
        of, n = Window.partitionBy(c), F.length("word") + 1
        behind = df.join(counts, "word", "left").withColumns({"_left": F.sum(n).over(of.orderBy(F.desc(F.coalesce("df", F.lit(0))), "word")) - 1, "_all": F.sum(n).over(of) - 1})
        return behind.where(F.col("df").isNotNull() & (F.col("_left") >= F.col("_all") * (least / (2 - least)) - 1e-9)).select(c, "word")

    shared = telling(wa, "a", wb).join(wb, "word").select("a", "b").union(telling(wb, "b", wa).join(wa, "word").select("a", "b")).distinct()
    shared = shared.withColumn("likeness", fuzzy.token_set_ratio(F.lower("a"), F.lower("b"))).where(F.col("likeness") >= least - 1e-9)
    low = compared(a.select(F.lower("a").alias("a")), b.select(F.lower("b").alias("b")), token_sets(least)).toDF("_a", "_b", "likeness")
    met = low.join(a, F.col("_a") == F.lower("a")).join(b, F.col("_b") == F.lower("b")).select("a", "b", "likeness")
    return shared.union(met).distinct()


def expanded(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests with what their aliases stand for; aliases are (alias, locality, city, state), nulls change nothing."""
    known = aliases.select(_plain("alias").alias("_alias"), *[F.col(c).alias(f"_{c}") for c in ("locality", "city", "state")]).dropDuplicates(["_alias"])

    def by(df: DataFrame, key: Column, columns: tuple[str, ...]) -> DataFrame:
        met = df.withColumn("_key", key).join(known, F.col("_key") == F.col("_alias"), "left")
        return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])

    whole = ("locality", "city", "state")
    given = lambda c: F.when(_plain(c) != "", _plain(c))
    requests = by(requests, F.coalesce(given("locality"), given("city"), given("raw_text")), whole)
    return by(by(requests, given("locality"), whole), given("city"), ("city", "state"))


def cache_key(locality: Column, city: Column, state: Column, country: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *map(_plain, (locality, city, state, country))), 256), 1, 32)


def resolved(requests: DataFrame, aliases: DataFrame, recent: DataFrame, seeds: DataFrame, stored: DataFrame, divisions: DataFrame, ttl_s: int = 900) -> DataFrame:
    """(request_id, tier, display_name, lon, lat, boundary_kind, buffer_m, geo_confidence), a row for each request.

    requests: request_id, locality, city, state, raw_text, lat, lon, radius_m, max_results.  recent and stored: key and an
    answer's columns, recent with age_s too.  seeds: position, city, state, locality, lon, lat, boxed.  divisions: name,
    lon, lat, confidence.
    """
    rows = expanded(requests, aliases)
    name = F.concat_ws(", ", *[F.when(_plain(c) != "", F.trim(c)) for c in ("locality", "city", "state")], F.lit(COUNTRY))
    target = F.coalesce(*[F.when(_plain(c) != "", F.trim(c)) for c in ("locality", "city", "raw_text")], F.lit(""))
    radius = geo.buffer_radius(F.col("max_results"), list(BOUNDS), DEFAULT_M)
    rows = spool(rows.withColumns({"key": cache_key(F.col("locality"), F.col("city"), F.col("state"), F.lit(COUNTRY)), "target": F.lower(target), "name": name, "buffer": radius.cast("int")}))

    def answer(df: DataFrame, tier: str, display, lon, lat, kind, buffer, confidence) -> DataFrame:
        values = (F.lit(tier), display, lon, lat, kind, buffer, confidence)
        return df.select("request_id", *[v.alias(c) for v, c in zip(values, _FIELDS, strict=True)])

    direct = rows.where("lat IS NOT NULL AND lon IS NOT NULL")
    out = answer(direct, "coordinates", F.col("name"), F.col("lon"), F.col("lat"), F.lit("buffered_point"), F.coalesce(F.col("radius_m").cast("int"), F.col("buffer")), F.lit(1.0))
    rest = rows.where("lat IS NULL OR lon IS NULL").drop("lat", "lon")

    def cached(df: DataFrame, table: DataFrame, tier: str) -> DataFrame:
        return df.join(table.dropDuplicates(["key"]), "key").select("request_id", F.lit(tier).alias("tier"), *_FIELDS[1:])

    def left(df: DataFrame, found: DataFrame) -> DataFrame:
        return df.join(found.select("request_id"), "request_id", "left_anti")

    found = spool(cached(rest, recent.where(F.col("age_s") < ttl_s), "recent"))
    out, rest = out.union(found), spool(left(rest, found))

    # Cities of the list, for requests that name no locality: of each close one its first area, the first by position.
    place = seeds.select("position", F.col("city").alias("s_city"), F.col("state").alias("s_state"), F.col("locality").alias("s_locality"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), F.col("boxed").alias("s_boxed"))
    asked = F.lower(F.coalesce(F.when(_plain("city") != "", F.trim("city")), F.col("target")))
    wide = rest.where(_plain("locality") == "").withColumn("asked", asked)
    cities = place.groupBy("s_city").agg(F.min_by(F.struct("position", "s_state", "s_lon", "s_lat", "s_boxed"), "position").alias("s")).select("s_city", "s.*")
    near = close_names(wide.select(F.col("asked").alias("a")), cities.select(F.col("s_city").alias("b")))
    met = wide.join(near, F.col("asked") == F.col("a")).join(cities, F.col("b") == F.col("s_city"))
    best = F.min_by(F.struct("s_city", "s_state", "s_lon", "s_lat", "s_boxed", "buffer"), "position").alias("s")
    boxed, over = F.col("s.s_boxed"), F.when(~F.col("s.s_boxed"), F.col("s.buffer"))
    kind = F.when(boxed, "admin_polygon").otherwise("buffered_point")
    title = lambda *parts: F.concat_ws(", ", *parts, F.lit(COUNTRY))
    found = spool(answer(met.groupBy("request_id").agg(best), "seed_city", title("s.s_city", "s.s_state"), F.col("s.s_lon"), F.col("s.s_lat"), kind, over, F.lit(0.95)))
    out, rest = out.union(found), spool(left(rest, found))

    # Areas, unless their city is another one than the request's.
    near = close_names(rest.select(F.col("target").alias("a")), place.select(F.lower("s_locality").alias("b")))
    met = rest.join(near, F.col("target") == F.col("a")).join(place, F.col("b") == F.lower("s_locality"))
    mine, theirs = _plain("city"), F.lower("s_city")
    same = (mine == "") | mine.contains(theirs) | theirs.contains(mine) | (fuzzy.token_set_ratio(mine, theirs) >= SAME_CITY)
    score = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("likeness"))
    met = met.withColumn("score", score).where(same)
    best = F.max_by(F.struct("s_locality", "s_city", "s_state", "s_lon", "s_lat", "s_boxed", "buffer", "score"), F.struct("score", -F.col("position"))).alias("s")
    sure = F.when(F.col("s.score") == 1.0, 0.96).otherwise(0.92)
    found = spool(answer(met.groupBy("request_id").agg(best), "seed_area", title("s.s_locality", "s.s_city", "s.s_state"), F.col("s.s_lon"), F.col("s.s_lat"), kind, over, sure))
    out, rest = out.union(found), spool(left(rest, found))

    found = spool(cached(rest, stored, "stored"))
    out, rest = out.union(found), spool(left(rest, found))
    named = divisions.select(_plain("name").alias("d_name"), F.col("name").alias("d_title"), F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"), "confidence").dropDuplicates(["d_name"])
    found = spool(answer(rest.join(named, F.col("target") == F.col("d_name")), "division", title("d_title"), F.col("d_lon"), F.col("d_lat"), F.lit("admin_polygon"), F.lit(None).cast("int"), F.col("confidence")))
    rest = left(rest, found)
    none = F.lit(None).cast("double")
    return out.union(found).union(answer(rest, "default", F.col("name"), none, none, F.lit(None).cast("string"), F.col("buffer"), F.lit(0.0)))
