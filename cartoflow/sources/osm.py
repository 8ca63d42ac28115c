"""Map elements and their tags, query text for their interpreter, and points of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag keys that categories come from, in order, and those of contacts and addresses.
CATEGORY_KEYS = ("amenity", "shop", "leisure", "tourism", "office", "craft")
PHONE_KEYS, EMAIL_KEYS, SITE_KEYS = ("phone", "contact:phone", "contact:mobile"), ("email", "contact:email"), ("website", "contact:website", "url")
ADDRESS_KEYS = ("addr:housenumber", "addr:street", "addr:suburb", "addr:city", "addr:state", "addr:postcode")


def interpreter_query(tags: list[tuple[str, str]], names: list[str], bbox: tuple[float, float, float, float], most: int = 20, cap: int = 300) -> str:
    """Union of distinct tag and name clauses in a box; names of three letters and more."""
    x1, y1, x2, y2 = bbox
    clauses = [f'nwr["{k}"="{v}"]' for k, v in dict.fromkeys(tags)] + [f'nwr["name"~"{n}",i]' for n in dict.fromkeys(names) if len(n) > 2]
    box = f"({y1},{x1},{y2},{x2})"
    return f"[out:json];({''.join(f'{c}{box};' for c in clauses[:most])});out center {cap};"


def _values(tags: Column, keys: tuple[str, ...]) -> Column:
    parts = F.flatten(F.transform(F.filter(F.array(*[tags[k] for k in keys]), lambda x: x.isNotNull()), lambda x: F.split(x, "[;,]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def contacts(tags: Column) -> Column:
    """struct(phones, emails, websites, address, closed): lists split at ; and , of several keys; closed by its tags."""
    address = F.map_filter(tags, lambda k, _: k.isin(*ADDRESS_KEYS))
    closed = F.exists(F.map_keys(tags), lambda k: k.startswith("disused:") | k.startswith("was:"))
    return F.struct(_values(tags, PHONE_KEYS).alias("phones"), _values(tags, EMAIL_KEYS).alias("emails"), _values(tags, SITE_KEYS).alias("websites"), F.transform_keys(address, lambda k, _: F.regexp_replace(k, "addr:", "")).alias("address"), closed.alias("closed"))


def osm_candidates(elements: DataFrame) -> DataFrame:
    """Named elements (type, id, lon, lat, center, tags) as candidates; a way's centre stands for it."""
    tags = F.col("tags")
    rows = elements.where(F.coalesce(F.trim(tags["name"]), F.lit("")) != "").withColumn("c", contacts(tags))
    return rows.select(
        F.lit("osm").alias("source"), F.concat_ws("/", "type", "id").alias("source_record_id"), tags["name"].alias("name"),
        F.coalesce("center.lon", "lon").alias("lon"), F.coalesce("center.lat", "lat").alias("lat"),
        F.filter(F.array(*[tags[k] for k in CATEGORY_KEYS]), lambda x: x.isNotNull()).alias("categories"), "c.phones", "c.emails", "c.websites", "c.address",
        F.when(F.col("c.closed"), "closed").alias("operating_status"), F.transform(F.map_entries(tags), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("osm_tags"),
    )


def wikidata_candidates(rows: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Points (item, label, coord as ``Point(lon lat)``); those whose label is an item's number go, those without a
    coordinate are at the box's centre."""
    x1, y1, x2, y2 = bbox
    part = lambda i: F.regexp_extract("coord", r"Point\(([-\d.]+) ([-\d.]+)\)", i).try_cast("double")
    return rows.where(~F.col("label").rlike(r"^Q\d")).select(F.lit("wikidata").alias("source"), F.col("item").alias("source_record_id"), F.col("label").alias("name"), F.coalesce(part(1), F.lit((x1 + x2) / 2)).alias("lon"), F.coalesce(part(2), F.lit((y1 + y2) / 2)).alias("lat"))
