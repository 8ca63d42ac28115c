"""The places extract: schema gate, flat candidates, derived columns, cache rules, source routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflow.functions import contact, geo
from cartoflow.operators.relational import require_columns

REQUIRED = {"id", "names", "taxonomy", "sources", "bbox"}


def scan_places(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """Open places within a box (and a ring): the box is compared with the extract's own, so Parquet statistics skip row
    groups; the ring is tested last, on what is left.  A null status is open."""
    x1, y1, x2, y2 = bbox
    rows = require_columns(spark.read.parquet(path), REQUIRED)
    rows = rows.where((F.col("bbox.xmin") <= x2) & (F.col("bbox.xmax") >= x1) & (F.col("bbox.ymin") <= y2) & (F.col("bbox.ymax") >= y1))
    if "operating_status" in rows.columns:
        rows = rows.where((F.col("operating_status") != "permanently_closed") | F.col("operating_status").isNull())
    lon, lat = (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2
    return rows if ring is None else rows.where(geo.in_ring(lon, lat, ring))


def cached_tile(df: DataFrame, path: str) -> bool:
    """Write a tile unless it is empty; whether it was written."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def flatten_places(df: DataFrame) -> DataFrame:
    """Nested places to flat candidates; those without a name or a coordinate (or at 0, 0) go."""
    optional = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    text = "array<string>"
    lon = F.coalesce(optional("lon", "double"), (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2)
    lat = F.coalesce(optional("lat", "double"), (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2)
    categories = F.filter(F.concat(F.array("taxonomy.primary"), F.coalesce("taxonomy.hierarchy", F.array().cast(text)), F.array(optional("basic_category", "string"))), lambda x: x.isNotNull())
    out = df.select(
        F.lit("overture").alias("source"), F.col("id").alias("source_record_id"), F.trim("names.primary").alias("name"), lon.alias("lon"), lat.alias("lat"), categories.alias("categories"),
        F.array_distinct(F.transform("sources", lambda s: s["dataset"])).alias("source_lineage"), F.try_element_at(F.transform("sources", lambda s: s["license"]), F.lit(1)).alias("licence"),
        *[F.coalesce(optional(c, text), F.array().cast(text)).alias(c) for c in ("phones", "emails", "websites", "socials")],
        optional("brand", "string").alias("brand"), optional("operating_status", "string").alias("operating_status"), optional("confidence", "double").alias("source_confidence"),
    )
    return out.where("name is not null and name <> '' and lon is not null and lat is not null and not (lon = 0 and lat = 0)")


def parse_failures(df: DataFrame) -> DataFrame:
    """Rows of an extract, and how many of them make no candidate (one row)."""
    return df.agg(F.count("*").alias("n_rows")).join(flatten_places(df).agg(F.count("*").alias("n_kept")), F.lit(True)).select("n_rows", (F.col("n_rows") - F.col("n_kept")).alias("parse_failures"))


def derived(df: DataFrame) -> DataFrame:
    """Columns that follow from a candidate's own: geohash, cleaned phones, domain, parts of the address."""
    first = lambda *keys: F.coalesce(*[F.col("address")[k] for k in keys])
    return df.withColumns({
        "geohash7": geo.geohash(F.col("lon"), F.col("lat"), 7),
        "phones_e164": F.transform("phones", contact.phone_cleaned),
        "website_domain": contact.domain(F.try_element_at("websites", F.lit(1))),
        "locality": first("locality", "suburb", "neighbourhood"),
        "city": first("city", "town"),
        "state": first("state", "region"),
        "country": F.coalesce(F.col("address")["country"], F.lit("India")),
    })


def use_cache(exists: Column, policy: Column, row_count: Column, prefer: Column, age_days: Column, max_age_days: Column, same_release: Column) -> Column:
    """A cache file serves unless it is missing, empty or refused; a preferred one at any age, another while it is fresh
    and of this release."""
    return exists & (policy != "force_fresh") & (row_count != 0) & (prefer | ((age_days <= max_age_days) & same_release))


def enabled_sources(sources: dict[str, DataFrame], enabled: set[str], fallback: str = "osm") -> DataFrame:
    """All rows of the enabled sources, of the fallback where none is: a union that keeps every row."""
    chosen = [df for name, df in sources.items() if name in enabled] or [sources[fallback]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)
