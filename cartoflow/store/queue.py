"""The work queue and other changes of the store, as selections and new column values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claimable(runs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest runs that wait, or whose lease is over."""
    return runs.where((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < now))).orderBy("created_at", "id").limit(limit)


def swept(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs that waited too long fail; those whose lease is over wait again."""
    old = F.col("created_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    status = F.when((F.col("status") == "queued") & old, "failed").when((F.col("status") == "running") & (F.col("lease_until") < now), "queued").otherwise(F.col("status"))
    return runs.withColumn("status", status)


def heartbeat(runs: DataFrame, run_id, now: Column, minutes: int) -> DataFrame:
    lease = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return runs.withColumn("lease_until", F.when(F.col("id") == run_id, lease).otherwise(F.col("lease_until")))


def suppression_rows(businesses: DataFrame) -> DataFrame:
    """A row a phone and one for the domain; mails are not suppressed."""
    phones = businesses.select("id", F.lit("phone").alias("kind"), F.explode("phones").alias("value"))
    return phones.where("value is not null").union(businesses.where("domain is not null").select("id", F.lit("domain"), "domain"))


def reverified(status: Column, old: Column, new: Column, extracted: Column, most: int = 3) -> Column:
    """What a visit shows: not modified, unchanged (fingerprints near each other), extracted anew, or failed."""
    return F.when(status == 304, "not_modified").when(F.bit_count(old.bitwiseXOR(new)) <= most, "unchanged").when(extracted, "extracted").otherwise("failed")


def batch_runs(areas: DataFrame, keywords: list[str]) -> DataFrame:
    """A run for each area and keyword; the keywords are a stated list."""
    return areas.select("*", F.explode(F.array(*map(F.lit, keywords))).alias("keyword"))


def reruns(runs: DataFrame, most: int) -> DataFrame:
    """New attempts of retryable runs that have tries left."""
    return runs.where(F.col("retryable") & (F.col("attempt") < most)).select(F.col("id").alias("parent_id"), (F.col("attempt") + 1).alias("attempt"))


def relabelled(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Decisions changed by labels (run_id, business_id, decision); the last label of a result counts."""
    last = labels.groupBy("run_id", "business_id").agg(F.max_by("decision", "created_at").alias("_d"))
    return results.join(last, ["run_id", "business_id"], "left").withColumn("decision", F.coalesce("_d", "decision")).drop("_d")
