"""Evaluation of decisions against labels, agreement, calibration, yield, run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.evaluate.sampling import dealt
from cartoflow.functions import stats
from cartoflow.operators.patterns import occurring
from cartoflow.operators.relational import non_empty


def confusion(rows: DataFrame, label: str, accepted: Column, *keys: str) -> DataFrame:
    """Cells and rates per key; what is for review is not accepted."""
    y = F.col(label)
    cells = rows.groupBy(*keys).agg(F.count_if(y & accepted).alias("tp"), F.count_if(~y & accepted).alias("fp"), F.count_if(~y & ~accepted).alias("tn"), F.count_if(y & ~accepted).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    safe = lambda x: F.greatest(x, F.lit(1))
    cells = cells.withColumns({"precision": tp / safe(tp + fp), "recall": tp / safe(tp + fn), "accuracy": (tp + tn) / safe(tp + fp + tn + fn), "base_rate": (tp + fn) / safe(tp + fp + tn + fn)})
    p, r = F.col("precision"), F.col("recall")
    f = lambda b: F.when(p + r > 0, (1 + b * b) * p * r / (b * b * p + r)).otherwise(0.0)
    return cells.withColumns({"f1": f(1.0), "f05": f(0.5)})


def macro(cases: DataFrame) -> DataFrame:
    """Averages over cases, pooled cells, the interval of pooled precision, and a warning when cases hardly differ."""
    out = cases.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.var_pop("precision").alias("precision_variance"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count("*").alias("n_cases"))
    return out.withColumns({"pooled": stats.wilson(F.col("tp"), F.col("tp") + F.col("fp")), "suspicious": (F.col("precision_variance") < 0.001) & (F.col("n_cases") > 2)})


def yield_metrics(rows: DataFrame, key: str, fetched: Column, useful: Column) -> DataFrame:
    """Rates of fetches and of useful ones; silent where much is fetched and nearly nothing is useful."""
    n = F.count("*")
    out = rows.groupBy(key).agg(n.alias("n"), (F.count_if(fetched) / n).alias("http_rate"), (F.count_if(useful) / n).alias("yield_rate"))
    return out.withColumn("silent", (F.col("n") >= 5) & (F.col("http_rate") >= 0.80) & (F.col("yield_rate") <= 0.15))


def canary_matches(entities: DataFrame, canaries: list[str]) -> DataFrame:
    """For each of a list of names, of any length, the first entity whose name has it (null: none)."""
    wanted = entities.sparkSession.createDataFrame([(c,) for c in canaries], "canary string")
    found = occurring(entities.select("id", F.lower("name").alias("text")), wanted, pattern="canary").groupBy(F.col("pattern").alias("canary")).agg(F.min("id").alias("first_id"))
    return wanted.join(found, "canary", "left")


def run_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Of businesses, all at once or by key (a run): nine counts and the mean confidence, in one pass.

    Rows have tier, phones and emails (arrays), website_url, website_domain, address_text, locality,
    independent_source_count and confidence; a null tier is unverified.
    """
    tier, given = F.col("tier"), lambda *c: reduce(lambda a, b: a | b, [F.col(x).isNotNull() for x in c])
    count = {
        "verified": tier == "Verified", "likely": tier == "Likely", "unverified": (tier == "Unverified") | tier.isNull(), "with_phone": non_empty(F.col("phones")), "with_email": non_empty(F.col("emails")),
        "with_website": given("website_url", "website_domain"), "with_address": given("address_text", "locality"), "multi_source": F.col("independent_source_count") > 1,
    }
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in count.items()], F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))


def shuffled_control(rows: DataFrame, deals: int = 5, buckets: int = 64) -> DataFrame:
    """Precision against labels that are dealt anew, ``deals`` times: its mean and population deviation (one row).

    Rows have id, label and accepted.  Labels move within buckets of ids, each the size of one task's share.
    """
    many = rows.select("id", "label", "accepted", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    bucket = F.conv(F.substring(dealt("id", "deal"), 1, 8), 16, 10).cast("long") % buckets
    after = F.lead("label").over(Window.partitionBy("deal", bucket).orderBy(F.md5(F.concat_ws(":", F.col("deal").cast("string"), F.col("id").cast("string"))), "id"))
    each = confusion(many.withColumn("dealt", F.coalesce(after, F.col("label"))), "dealt", F.col("accepted"), "deal")
    return each.agg(F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 4).alias("precision_mean"), F.round(F.coalesce(F.stddev_pop("precision"), F.lit(0.0)), 4).alias("precision_std"), F.count("*").alias("runs"))


def yield_ratio(got: DataFrame, expected: DataFrame, key: str, default: int = 3, least: float = 0.6) -> DataFrame:
    rows = got.join(expected, key, "left").withColumn("expected_min", F.coalesce("expected_min", F.lit(default)))
    return rows.withColumn("ratio", F.col("accepted") / F.col("expected_min")).withColumn("passed", F.col("ratio") >= least)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def calibration_error(rows: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    of = rows.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"))
    return of.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 4).alias("ece"))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two 0/1 raters as an aggregate; 1 where there is nothing, or nothing to disagree about."""
    po, pa, pb = F.avg((a == b).cast("int")), F.avg(a), F.avg(b)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when((F.count("*") == 0) | (pe >= 1), 1.0).otherwise((po - pe) / (1 - pe))


def dual_annotation(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    out = rows.agg(kappa(a, b).alias("kappa"), F.avg((a == b).cast("int")).alias("agreement"), F.sum(a).alias("yes_a"), F.sum(b).alias("yes_b"), F.count("*").alias("n"))
    band = F.lit("almost perfect")
    for most, name in ((0.8, "substantial"), (0.6, "moderate"), (0.4, "fair"), (0.2, "slight")):
        band = F.when(F.col("kappa") <= most, name).otherwise(band)
    return out.withColumns({"ci_a": stats.wilson(F.col("yes_a"), F.col("n")), "ci_b": stats.wilson(F.col("yes_b"), F.col("n")), "band": F.when(F.col("kappa") < 0, "poor").otherwise(band)})


def run_evaluation(entities: DataFrame, least: int = 30) -> DataFrame:
    """Tiers (an unknown one is unverified), fill rates, mean confidence; an interval from ``least`` entities on."""
    n, t = F.count("*"), F.col("tier")
    out = entities.agg(n.alias("n"), F.count_if(t == "Verified").alias("verified"), F.count_if(t == "Likely").alias("likely"), F.count_if(~t.isin("Verified", "Likely") | t.isNull()).alias("unverified"), F.round(F.count("phone") / F.greatest(n, F.lit(1)), 3).alias("phone_rate"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    return out.withColumn("verified_ci", F.when(F.col("n") >= least, stats.wilson(F.col("verified"), F.col("n"))))


def permutation_test(rows: DataFrame, by: str, value: Column, group: Column, key: str, rounds: int, seed: int = 0) -> DataFrame:
    """Per ``by``: p of the group's mean against ``rounds`` relabellings, by hash of each row's key, so the same wherever
    the row is read.  Partial means are summed before anything is shuffled."""
    each = rows.select(by, value.cast("double").alias("_x"), group.cast("boolean").alias("_g"), F.col(key).alias("_i"))
    share = each.groupBy(by).agg(F.avg(F.col("_g").cast("int")).alias("_share"), F.avg(F.when(F.col("_g"), F.col("_x"))).alias("_seen"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "round", "_i")), 1, 8), 16, 10).cast("long") / F.lit(1 << 32)
    null = each.join(share, by).select(by, "_x", "_share", "_seen", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "_i").withColumn("_g", draw < F.col("_share"))
    means = null.groupBy(by, "round").agg(F.avg(F.when(F.col("_g"), F.col("_x"))).alias("m"), F.first("_seen").alias("_seen"))
    return means.groupBy(by).agg(stats.permutation_p(F.count_if(F.col("m") >= F.col("_seen")), F.count("*")).alias("p"))


def baselines(rows: DataFrame, keyword: str, seed: int = 0) -> DataFrame:
    """Decisions of simple rivals in long form (baseline, id, accepted, label): all, a hashed coin, near, the keyword's
    words in the name, and labels dealt anew."""
    words = [w for w in keyword.lower().split() if len(w) > 3]
    hit = F.lit(False)
    for w in words:
        hit |= F.lower("name").contains(w)
    hashed = lambda salt: F.conv(F.substring(dealt("id", salt), 1, 8), 16, 10).cast("long")
    coin = lambda salt: hashed(salt) % 2 == 0
    row = lambda name, ok, y=F.col("label"): F.struct(F.lit(name).alias("baseline"), ok.alias("accepted"), y.alias("label"))
    after = F.lead("label", 1).over(Window.partitionBy(hashed("deal") % 64).orderBy(dealt("id", seed), "id"))
    rows = rows.withColumn("_dealt", F.coalesce(after, F.col("label")))
    return rows.select("id", F.inline(F.array(row("all", F.lit(True)), row("random", coin(seed)), row("near", F.lit(True)), row("substring", hit), row("shuffled", F.col("accepted"), F.col("_dealt")))))


def mutated(rows: DataFrame, kind: str) -> DataFrame:
    """Inputs that must change what comes out; a change of labels needs a column of them."""
    if kind in ("inverted", "shuffled") and "label" not in rows.columns:
        raise ValueError(f"{kind}: no column of labels")
    none = F.array().cast("array<string>")
    changes = {
        "no_categories": {"categories": none},
        "generic_category": {"categories": F.array(F.lit("point_of_interest"))},
        "mangled_text": {"name": F.regexp_replace("name", "[aeiou]", "x")},
        "geo_bypass": {"lon": F.lit(0.0), "lat": F.lit(0.0)},
        "stale_query": {"name": F.reverse("name")},
    }
    if kind == "inverted":
        return rows.withColumn("label", ~F.col("label"))
    if kind == "empty":
        return rows.limit(0)
    if kind == "shuffled":
        return rows.withColumn("label", F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    return rows.withColumns(changes[kind])


#: Relations that decisions must keep, as (name, change of the candidates, what is asked): the same ids, or no new ones.
RELATIONS = ("permutation", "duplication", "restriction", "irrelevant_column", "case", "closing", "moved_within", "typo")


def related(rows: DataFrame, relation: str) -> tuple[DataFrame, str]:
    """Candidates changed so that what is accepted must stay the ``same``, or at most be ``fewer``."""
    if relation == "permutation":
        return rows.repartition(3, F.xxhash64("id", F.lit(1))), "same"
    if relation == "duplication":
        return rows.unionByName(rows), "same"
    if relation == "restriction":
        return rows.where(F.col("id") % 2 == 0), "fewer"
    changes = {
        "irrelevant_column": ({"shade": F.lit("blue")}, "same"),
        "case": ({"name": F.upper("name")}, "same"),
        "closing": ({"operating_status": F.when(F.col("id") % 3 == 0, "permanently_closed").otherwise(F.col("operating_status"))}, "fewer"),
        "moved_within": ({"lon": F.col("lon") + 0.0001}, "same"),
        "typo": ({"name": F.regexp_replace("name", "o", "0")}, "fewer"),
    }
    return rows.withColumns(changes[relation][0]), changes[relation][1]


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jaccard index of two outputs' keys: what metamorphic relations compare."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return both.agg(F.coalesce(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*"), F.lit(1.0)).alias("jaccard"))
