"""Writes: checked appends, exports, sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflow.functions.contact import is_mobile
from cartoflow.store.keyed import BATCH, append_batch

COMPLIANCE = "Check numbers against the do-not-disturb register before calling."


def append_checked(rows: DataFrame, table: str, path: str | None = None, batch: str | None = None) -> DataFrame:
    """Append rows to a Parquet table as one batch; what was appended must be as many rows as there were.  A batch with a name
    may be run again.  Without a path the rows are given back as they would be written."""
    rows = rows.withColumn("_table", F.lit(table))
    if path is None:
        return rows
    append_batch(rows, path, uuid.uuid4().hex if batch is None else batch)
    return rows.sparkSession.read.parquet(path).drop(BATCH)


def export_rows(leads: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns, arrays as text, with the subscriber risk and the compliance note."""
    kinds = dict(leads.dtypes)
    out = [F.array_join(c, "; ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    return leads.select(*out, F.exists("phones", is_mobile).alias("dnd_subscriber_risk"), F.lit(COMPLIANCE).alias("compliance"))


# Fixed values of the lead export.
MOBILE, LANDLINE, BASIS = "personal_mobile_line", "business_landline", "DPDP_3_c_ii_public_source"


def lead_export(leads: DataFrame) -> DataFrame:
    """The fifteen columns of a lead export, as text: nulls are empty, arrays are joined, and so is a confidence of 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(F.filter(c, lambda x: x != ""), "; "), F.lit(""))
    mobile = F.exists(F.coalesce("phones_e164", F.array().cast("array<string>")), is_mobile)
    out = {
        "name": text("canonical_name"), "category": text("primary_category"), "phones": listed("phones_e164"), "emails": listed("emails"), "website": text("website_url"), "address": text("address_text"),
        "locality": text("locality"), "city": text("city"), "state": text("state"), "tier": text("tier"), "confidence": F.when(F.col("confidence") != 0, F.col("confidence").cast("string")).otherwise(""),
        "independent_sources": F.coalesce("independent_source_count", F.lit(0)).cast("string"), "new_lead": text("is_new_business"), "dnd_subscriber_risk": F.when(mobile, MOBILE).otherwise(LANDLINE), "compliance_basis": F.lit(BASIS),
    }
    return leads.select(*[c.alias(n) for n, c in out.items()])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What ``write_csv`` has written, as text; empty fields are empty."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_sheets(results: DataFrame, path: str) -> None:
    """The sheets of a workbook, a folder of CSV files each."""
    for name, rows in sheets(results).items():
        write_csv(rows, f"{path}/{name}")


def sheets(results: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of a workbook."""
    return {d: results.where(F.col("decision") == d) for d in ("accepted", "review", "rejected")}
