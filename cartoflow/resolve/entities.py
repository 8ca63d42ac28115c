"""Entity resolution: blocked pairs, pair probabilities, clusters, golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions import contact, fuzzy, geo, text
from cartoflow.operators.components import components
from cartoflow.operators.relational import blocked_pairs

MATCH = 0.85


def candidate_pairs(rows: DataFrame, neighbours: bool = False) -> DataFrame:
    """Pairs (a, b) of rows (id, lon, lat, phone, domain) that share a geohash cell, phone or domain; with
    ``neighbours`` cells next to each other count as shared."""
    keys = {"phone": F.col("phone"), "domain": F.col("domain")}
    if not neighbours:
        return blocked_pairs(rows, keys | {"cell": geo.geohash(F.col("lon"), F.col("lat"), 7)})
    left = rows.select(F.col("id").alias("x"), F.explode(geo.geohash_block(F.col("lon"), F.col("lat"), 7)).alias("cell"))
    right = rows.select(F.col("id").alias("y"), geo.geohash(F.col("lon"), F.col("lat"), 7).alias("cell"))
    near = left.join(right, "cell").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return near.union(blocked_pairs(rows, keys)).distinct()


def location_score(metres: Column) -> Column:
    return F.when(metres <= 30, 1.0).when(metres <= 80, 0.75).when(metres <= 200, 0.40).otherwise(0.0)


def pair_scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, probability): .95 with a phone in common, .92 with a domain, else by name and place.

    Only pairs that neither settles reach the fuzzy measure.
    """
    side = lambda s: rows.select(F.col("id").alias(s), text.business_name(F.col("name")).alias(f"{s}_name"), F.col("lon").alias(f"{s}_lon"), F.col("lat").alias(f"{s}_lat"), F.col("phone").alias(f"{s}_phone"), F.col("domain").alias(f"{s}_domain"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sure = F.when(F.col("a_phone") == F.col("b_phone"), 0.95).when(F.col("a_domain") == F.col("b_domain"), 0.92)
    both = both.withColumn("sure", sure)
    settled = both.where("sure is not null").select("a", "b", F.col("sure").alias("probability"))
    metres = geo.flat_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    open_ = both.where("sure is null").withColumns({"_l": location_score(metres), "_n": fuzzy.token_sort_ratio("a_name", "b_name")})
    return settled.union(open_.select("a", "b", F.least(F.lit(1.0), 0.55 * F.col("_n") + 0.45 * F.col("_l")).alias("probability")))


def sure_links(rows: DataFrame) -> DataFrame:
    """(a, b, probability): each row with the least id of its phone, and of its domain.

    Rows of one phone (or domain) are a match each with each; for clusters a link to one of them says the same, so a key
    that a third of all rows share makes as many links as it has rows, and no pairs of pairs.
    """
    def linked(key: str, probability: float) -> DataFrame:
        keyed = rows.where(F.col(key).isNotNull()).select("id", key)
        return keyed.join(keyed.groupBy(key).agg(F.min("id").alias("a")), key).where("a <> id").select("a", F.col("id").alias("b"), F.lit(probability).alias("probability"))

    return linked("phone", 0.95).union(linked("domain", 0.92))


def match_links(rows: DataFrame) -> DataFrame:
    """What ``clusters`` needs of rows (id, name, lon, lat, phone, domain): ``sure_links``, and what names and places link
    in each cell; no pairs of a block."""
    from cartoflow.resolve.blocks import name_links

    return sure_links(rows).union(name_links(rows))


def clusters(rows: DataFrame, scores: DataFrame, least: float = MATCH) -> DataFrame:
    """(id, cluster): the least id that pairs of ``least`` and more lead to."""
    roots = components(scores.where(F.col("probability") >= least).select("a", "b")).withColumnsRenamed({"node": "id", "root": "cluster"})
    return rows.select("id").join(roots, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def golden_records(rows: DataFrame, of: DataFrame) -> DataFrame:
    """One entity a cluster from its members, in the order of their ids: longest name, all phones, mails, sites and
    categories once, mean place, the best decision, sources.  Extra columns of rows are ignored."""
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    m = rows.join(of, "id").select("cluster", "id", "name", "lon", "lat", "phone", "domain", "source", have("category", "string").alias("category"), have("email", "string").alias("email"), have("website", "string").alias("website"), have("social", "string").alias("social"), have("status", "string").alias("status"), have("address", "string").alias("address"), have("decision", "string").alias("decision"), have("p", "double").alias("p"))
    values = lambda c: F.array_sort(F.collect_set(c))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id")))
    decision = F.when(F.bool_or(F.col("decision") == "accepted"), "accepted").when(F.bool_or(F.col("decision") == "review"), "review").otherwise("accepted")
    out = m.groupBy("cluster").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("id"))).alias("canonical_name"), values(F.coalesce(contact.phone_e164(F.col("phone")), F.col("phone"))).alias("phones_e164"), values(F.lower("email")).alias("emails"),
        values("category").alias("categories"), first("domain").alias("website_domain"), first("website").alias("website_url"), values("social").alias("socials"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        F.size(F.collect_set("source")).alias("independent_source_count"), F.array_sort(F.collect_set(F.concat_ws(":", "source", "id"))).alias("source_ids"), F.min_by("address", "id").alias("address"), F.min_by("status", "id").alias("operating_status"),
        decision.alias("decision"), F.max("p").alias("relevance_p"),
    )
    return out.withColumns({"id": F.col("cluster"), "socials": contact.socials(F.col("socials")), "name_norm": text.business_name(F.col("canonical_name")), "geohash7": geo.geohash(F.col("lon"), F.col("lat"), 7)})


def independent(a: Column, b: Column) -> Column:
    """Lineages of different names are independent."""
    return F.lower(F.trim(a)) != F.lower(F.trim(b))
