"""Expectations of an output table, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suite(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(expectation, passed, detail): row count within bounds, no null names, phones well formed, no tier that is nearly
    all (of twenty rows and more)."""
    by_tier = rows.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("name").isNull()).alias("nameless"), F.count_if(~F.col("phone").rlike(r"^\+91[0-9]{10}$")).alias("bad"))
    one = by_tier.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("nameless"), F.lit(0)).alias("nameless"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    row = lambda name, ok, detail: F.struct(F.lit(name).alias("expectation"), ok.alias("passed"), detail.cast("string").alias("detail"))
    share = F.col("top") / F.greatest("n", F.lit(1))
    return one.select(F.inline(F.array(row("row_count", F.col("n").between(least, most), F.col("n")), row("names", F.col("nameless") == 0, F.col("nameless")), row("phones", F.col("bad") == 0, F.col("bad")), row("tier_share", (F.col("n") < 20) | (share < 0.98), share))))
