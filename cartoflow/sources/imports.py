"""Files and requests that users bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns by the headers that they may have.
HEADERS = {"name": ("name", "Name", "business_name"), "lon": ("lon", "longitude"), "lat": ("lat", "latitude")}


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """CSV (with or without a byte order mark) or JSON by extension; all columns as text, and the file's name."""
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path).withColumn("file", F.col("_metadata.file_name"))


def import_candidates(rows: DataFrame) -> DataFrame:
    """Rows with a name and a coordinate that parses and is not zero; identified by file and id, or name."""
    have = {c.lstrip("﻿"): c for c in rows.columns}
    any_of = lambda names: F.coalesce(*[F.col(f"`{have[n]}`").cast("string") for n in names if n in have], F.lit(None).cast("string"))
    name = any_of(HEADERS["name"])
    out = rows.select(F.lit("import").alias("source"), F.concat_ws(":", "file", F.coalesce(any_of(("id",)), name)).alias("source_record_id"), F.trim(name).alias("name"), any_of(HEADERS["lon"]).try_cast("double").alias("lon"), any_of(HEADERS["lat"]).try_cast("double").alias("lat"), *[any_of((c,)).alias(c) for c in ("category", "phone", "email", "website", "address")])
    return out.where("name is not null and name <> '' and lon is not null and lat is not null and lon <> 0 and lat <> 0")


def parse_request(raw: Column) -> Column:
    """``keywords in place``: keywords by comma or semicolon, the place's parts by comma."""
    halves = F.split(raw, r"(?i)\s+in\s+", 2)
    parts = lambda x, by: F.filter(F.transform(F.split(x, by), lambda v: F.trim(v)), lambda v: v != "")
    return F.struct(parts(halves[0], "[,;]").alias("keywords"), F.coalesce(parts(F.try_element_at(halves, F.lit(2)), ","), F.array().cast("array<string>")).alias("location"))


def aliased(value: Column, aliases: dict[str, str]) -> Column:
    """A name by its alias (compared in lower case), white space collapsed."""
    value = F.trim(F.regexp_replace(value, r"\s+", " "))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[F.lower(value)], value)
