"""Checks of entities in long form, confidence, tiers, borderline rules, ring order, completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions import contact, fuzzy, geo

# What the confidence is made of.
BASE = 0.35
GAINS = {"phone_valid": 0.15, "email_syntax": 0.10, "website_accessible": 0.10, "multi_source_agreement": 0.20, "operating_status_open": 0.05, "address_complete": 0.05}
PENALTIES = {"personal_number_risk": -0.10, "closed": -0.30}
VERIFIED, LIKELY = 0.80, 0.60
RINGS = (1500, 3500, 6000)


def validate_weights(weights: dict[str, float], allowed: set[str] = frozenset(GAINS)) -> None:
    """Weights must be exactly the known ones."""
    if set(weights) != set(allowed):
        raise ValueError(f"unknown weights {sorted(set(weights) - set(allowed))}, missing {sorted(set(allowed) - set(weights))}")


def checks(entities: DataFrame, ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """One row a check (entity_id, check_name, outcome, detail): passed, failed or inconclusive.

    Entities have id, lon, lat, phone, email, website, website_ok, independent_source_count, operating_status, address.
    """
    outcome = lambda ok: F.when(ok.isNull(), "inconclusive").when(ok, "passed").otherwise("failed")
    phone, status = F.col("phone"), F.lower("operating_status")
    inside = geo.boundary(F.col("lon"), F.col("lat"), ring, "verify") if ring else F.lit(None).cast("boolean")
    row = lambda name, value, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("check_name"), value.alias("outcome")))
    valid = F.when(phone.isNotNull(), F.coalesce(phone.rlike(r"^\+91\d{10}$"), F.lit(False)))
    risk = contact.is_mobile(phone) & F.col("website").isNull()
    mailed = F.when(F.col("email").isNotNull(), contact.email_valid(F.col("email")))
    closed = F.coalesce(status.rlike("closed|disused"), F.lit(False))
    rows = F.array(
        row("inside_boundary", outcome(inside)), row("phone_valid", outcome(valid)), row("personal_number_risk", F.lit("failed"), risk),
        row("multi_source_agreement", F.lit("passed"), F.col("independent_source_count") >= 2), row("email_syntax", outcome(mailed)), row("email_mx", F.lit("inconclusive"), F.col("email").isNotNull()),
        row("website_accessible", outcome(F.col("website_ok"))), row("operating_status_open", outcome(~closed)), row("address_complete", outcome(F.length(F.coalesce("address", F.lit(""))) > 10)),
    )
    return entities.select(F.col("id").alias("entity_id"), F.inline(F.filter(rows, lambda r: r.isNotNull())))


def site_names_entity(text: Column, name: Column, least: float = 0.75) -> Column:
    """Whether a page (its first 5,000 characters) names an entity: as it is, or closely."""
    head = F.lower(F.substring(text, 1, 5000))
    return F.coalesce(head.contains(F.lower(name)) | (fuzzy.partial_ratio(F.lower(name), head) >= least), F.lit(False))


def scored(entities: DataFrame, checked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """confidence and tier of each entity, from its checks."""
    weights = weights or GAINS
    validate_weights(weights)
    passed = lambda c: F.coalesce(F.bool_or((F.col("check_name") == c) & (F.col("outcome") == "passed")), F.lit(False)).alias(c)
    failed = lambda c, to: F.coalesce(F.bool_or((F.col("check_name") == c) & (F.col("outcome") == "failed")), F.lit(False)).alias(to)
    wide = checked.groupBy(F.col("entity_id").alias("id")).agg(*[passed(c) for c in weights], failed("personal_number_risk", "personal_number_risk"), failed("operating_status_open", "closed"))
    rows = entities.join(wide, "id", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    total = reduce(lambda a, b: a + b, [F.when(on(c), w).otherwise(0.0) for c, w in {**weights, **PENALTIES}.items()], F.lit(BASE))
    rows = rows.withColumn("confidence", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), total)), 3))
    corroborated = on("multi_source_agreement") | on("website_accessible") | (F.coalesce("independent_source_count", F.lit(0)) >= 2)
    return rows.withColumn("tier", tier(F.col("confidence"), corroborated)).drop(*weights, *PENALTIES)


def tier(confidence: Column, corroborated: Column) -> Column:
    return F.when((confidence >= VERIFIED) & corroborated, "Verified").when(confidence >= LIKELY, "Likely").otherwise("Unverified")


def borderline(confidence: Column) -> Column:
    return confidence.between(0.45, 0.65)


def needs_contact(confidence: Column, website: Column, phone: Column) -> Column:
    return (confidence >= 0.40) & (confidence < 0.70) & website.isNotNull() & phone.isNull()


def ring_sorted(rows: DataFrame, rings: tuple[int, ...] = RINGS) -> DataFrame:
    """By distance ring, then confidence, then distance; no distance counts as far."""
    d = F.coalesce("distance_m", F.lit(99_999.0))
    ring = F.lit(len(rings))
    for i, most in reversed(list(enumerate(rings))):
        ring = F.when(d <= most, i).otherwise(ring)
    return rows.withColumn("ring", ring).orderBy("ring", F.desc("confidence"), d, "id")


def completion_reason(row: dict[str, Column]) -> Column:
    """The first that holds: failed, cancelled, target met, budget, sources, nothing found, nothing new, low relevance,
    exhausted; low relevance where nothing is proven."""
    c = row
    seen, accepted = F.coalesce(c["candidates_seen"], c["accepted"]), c["accepted"]
    return (
        F.when(c["critical_error"], "failed")
        .when(c["cancelled"], "cancelled")
        .when(accepted >= c["target"], "target_met")
        .when(c["budget_exhausted"], "budget_exhausted")
        .when(c["any_failed"], "partial_sources")
        .when((seen == 0) & (accepted == 0) & (c["raw_count"] > 0), "keyword_plan_matched_nothing")
        .when((seen == 0) & (accepted == 0), "no_candidates_found")
        .when((seen > 0) & (c["new_businesses"] == 0) & (c["matched_existing"] > 0), "no_new_leads")
        .when((seen > 0) & (accepted / F.greatest(seen, F.lit(1)) < 0.05), "low_relevance")
        .when(c["reached_final_rung"] & (c["last_rung_new"] == 0), "region_exhausted")
        .otherwise("low_relevance")
    )


def final_status(reason: Column, degraded: Column) -> Column:
    return F.when(reason == "failed", "failed").when(reason == "cancelled", "cancelled").when(degraded, "degraded").when(reason.isin("partial_sources", "budget_exhausted"), "partial").otherwise("completed")


def evidence(results: DataFrame, sources: DataFrame) -> DataFrame:
    """What completion is decided from: counts of results and the failed sources."""
    counts = results.agg(F.count("*").alias("candidates_seen"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if("is_new").alias("new_businesses"))
    failed = sources.agg(F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("source")))).alias("failed_names"))
    return counts.crossJoin(failed).withColumn("any_failed", F.size("failed_names") > 0)  # one row each
