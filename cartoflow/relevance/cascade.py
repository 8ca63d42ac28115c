"""The relevance cascade as one chain of expressions: profile, gates, features, logistic score, decision.

A card's terms are literals of the plan, so a pass over candidates is one narrow stage without a join or a UDF.  What many
later expressions read is computed once a row (``held``): a filter on a decision would else be pushed below all of it, as
one condition that repeats the profile wherever it is named.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.functions import geo, stats, text
from cartoflow.relevance.dictionary import NON_EVIDENCE, Concept
from cartoflow.relevance.explain import top_contributions

# Weights of the logistic score.
BIAS = -0.8
WEIGHTS = {"f_def_cat": 3.2, "f_def_osm": 2.8, "f_def_web": 2.6, "f_def_name": 1.4, "f_name_only_primary": -0.5, "f_sup_count": 0.8, "f_host_cat": 0.2, "f_src_agree": 0.5, "f_cat_conf": 0.4, "f_sem_pos": 1.0, "f_sem_neg": -1.4, "f_sem_margin": 1.4, "f_ce": 2.2, "f_nonev_only": -2.8}
CLOSED = ("permanently_closed", "closed", "disused")
STOPWORDS = ("and", "or", "of", "the", "shop", "store", "service", "services")


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _maybe(df: DataFrame, column: str, kind: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def held(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows and columns, with ``columns`` behind a generator of one row, through which nothing is inlined."""
    return df.withColumn("_held", F.struct(*columns)).select(*[c for c in df.columns if c not in columns], F.inline(F.array("_held"))).select(*df.columns)


def category_tokens(category: Column) -> Column:
    return F.filter(F.split(F.lower(category), r"[=_\-/>\.\s]+"), lambda x: x != "")


def taxonomy_verdict(categories: Column, card: Concept) -> Column:
    """accept_candidate, reject or uncertain: a card's category matches where its tokens are all in a candidate's."""

    def listed(cards: tuple[str, ...]) -> Column:
        sets = [sorted({x for x in re.split(r"[=_\-/>\.\s]+", c.lower()) if x}) for c in cards]
        within = lambda s: F.exists(categories, lambda c: F.size(F.array_except(_texts(s), category_tokens(c))) == 0)
        return _any([within(s) for s in sets if s])

    return F.when(F.coalesce(F.size(categories), F.lit(0)) == 0, "uncertain").when(listed(card.defining), "accept_candidate").when(listed(card.incompatible), "reject").otherwise("uncertain")


def category_matches(wanted: Column, category: Column) -> Column:
    """Equal, or one within the other once _ is a blank; else tokens (stop words aside) one within the other's."""
    plain = lambda x: F.regexp_replace(F.lower(x), "_", " ")
    a, b = plain(wanted), plain(category)
    tokens = lambda x: F.array_except(F.split(x, r"\s+"), _texts(STOPWORDS))
    x, y = tokens(a), tokens(b)
    common = F.size(F.array_intersect(x, y))
    return (a == b) | a.contains(b) | b.contains(a) | ((common > 0) & (common == F.least(F.size(x), F.size(y))))


def keyword_match(df: DataFrame, categories: list[str], patterns: list[str], synonyms: list[str]) -> DataFrame:
    """Candidates that a plan matches: .90 by category, .75 by a name pattern, .60 by a synonym or a word of one."""
    name = F.lower("name")
    listed = lambda w: F.exists("categories", lambda c: category_matches(F.lit(w), c))
    by_category = _any([listed(w) for w in categories])
    by_pattern = _any([F.col("name").rlike(f"(?i){p}") for p in patterns])
    words = sorted({w for s in synonyms for w in s.lower().split() if len(w) > 2})
    by_synonym = _any([name.contains(s.lower()) for s in synonyms]) | F.arrays_overlap(text.words(text.sanitized(F.col("name"))), _texts(words)) if synonyms else F.lit(False)
    reason = F.when(by_category, "category").when(by_pattern, "name_pattern").when(by_synonym, "synonym")
    score = F.when(by_category, 0.90).when(by_pattern, 0.75).when(by_synonym, 0.60)
    return df.withColumns({"score": score, "match_reason": reason}).where("score is not null")


def profiled(df: DataFrame) -> DataFrame:
    """clean_name, tokens, bigrams, evidence and non_evidence tokens, category and web tokens, profile_text."""
    clean = text.sanitized(F.col("name"))
    tokens = text.words(F.col("clean_name"))
    non = _texts(NON_EVIDENCE)
    df = df.withColumn("clean_name", clean).withColumn("name_tokens", tokens)
    many = lambda c: F.array_distinct(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text.words(text.sanitized(x)))))
    web, brand, tags = _maybe(df, "web_meta", "string"), _maybe(df, "brand", "string"), _maybe(df, "osm_tags", "array<string>")
    label = lambda k, v: F.when(F.coalesce(F.length(v), F.lit(0)) > 0, F.concat(F.lit(k), v))
    cats, osm = F.array_join("categories", "; "), F.array_join(tags, "; ")
    both = F.when((F.coalesce(F.length(cats), F.lit(0)) > 0) | (F.coalesce(F.length(osm), F.lit(0)) > 0), F.rtrim(F.concat(F.lit("categories: "), F.coalesce(cats, F.lit("")), F.lit("; osm: "), F.coalesce(osm, F.lit("")))))
    df = df.withColumns({
        "name_bigrams": text.bigrams(F.col("name_tokens")),
        "evidence": F.array_distinct(F.filter("name_tokens", lambda x: ~F.array_contains(non, x))),
        "non_evidence": F.array_distinct(F.filter("name_tokens", lambda x: F.array_contains(non, x))),
        "category_tokens": many(F.col("categories")),
        "web_tokens": F.coalesce(text.words(text.sanitized(web)), F.array().cast("array<string>")),
        "brand_tokens": F.coalesce(text.words(text.sanitized(brand)), F.array().cast("array<string>")),
        "profile_text": F.concat_ws(" | ", "name", both, label("brand: ", brand), label("web: ", F.substring(web, 1, 300))),
    })
    return held(df, ["clean_name", "name_tokens", "name_bigrams", "evidence", "non_evidence", "category_tokens", "web_tokens", "brand_tokens"])


def _defined_by_name(card: Concept) -> Column:
    paired = lambda t: F.exists("name_bigrams", lambda b: b.contains(t))
    return _any([F.array_contains("evidence", t) | F.col("clean_name").contains(t) | paired(t) for t in card.evidence_terms()])


def hard_gates(df: DataFrame, card: Concept, ring: list[tuple[float, float]] | None = None, excludes: tuple[str, ...] = ()) -> DataFrame:
    """reason_code of the first gate that a candidate fails (null: none), and edge_case: just outside the boundary."""
    if "evidence" not in df.columns:
        df = profiled(df)
    status = F.lower(_maybe(df, "operating_status" if "operating_status" in df.columns else "status", "string"))
    where = geo.boundary(F.col("lon"), F.col("lat"), ring) if ring else F.lit("inside")
    brand = text.sanitized(_maybe(df, "brand", "string"))
    clean = [x for x in (re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", e)).strip().lower() for e in excludes) if x]
    excluded = _any([F.col("clean_name").contains(x) | F.array_contains("evidence", x) for x in clean])
    other_brand = _any([brand.contains(x) for x in card.incompatible_brands])
    defined = _defined_by_name(card)
    padded = F.concat(F.lit(" "), "clean_name", F.lit(" "))
    veto = _any([F.array_contains("evidence", v) | F.array_contains("category_tokens", v) | padded.contains(f" {v} ") for v in card.veto_terms()])
    rejected = (taxonomy_verdict(F.col("categories"), card) == "reject") & F.lit(not card.synthesized)
    code = (
        F.when(status.isin(*CLOSED), "closed")
        .when(where == "outside", "outside_boundary")
        .when(excluded, "user_exclude")
        .when(F.coalesce(other_brand, F.lit(False)), "incompatible_brand")
        .when(rejected & ~defined, "incompatible_category")
        .when(veto & ~defined, "veto_term")
    )
    return df.withColumns({"reason_code": code, "edge_case": where == "edge"})


def nearest(vector: Column, prototypes: list[list[float]], missing: float) -> Column:
    """The largest cosine to a card's few prototypes, mapped to 0..1; where there is no vector, what is missing says."""
    if not prototypes:
        return F.lit(missing)
    best = [stats.unit_cosine(F.array(*[F.lit(float(x)) for x in p]), vector) for p in prototypes]
    return F.when(vector.isNotNull(), F.greatest(*best) if len(best) > 1 else best[0]).otherwise(F.lit(missing))


def features(df: DataFrame, card: Concept, sem: tuple[float, float] = (0.5, 0.5), ce: float = 0.5, prototypes: tuple[list[list[float]], list[list[float]]] | None = None) -> DataFrame:
    """The fourteen features as columns; ``sem`` and ``ce`` are what a missing model says.  With ``prototypes`` (positive,
    negative) and a column ``embedding`` the semantic ones are cosines."""
    positive, negative = (nearest(F.col("embedding"), p, m) for p, m in zip(prototypes, sem, strict=True)) if prototypes and "embedding" in df.columns else (F.lit(sem[0]), F.lit(sem[1]))
    if "evidence" not in df.columns:
        df = profiled(df)
    flat = [" ".join(re.sub(r"[^\w\s]", " ", c.lower()).split()) for c in card.defining]
    hosts = [" ".join(re.sub(r"[^\w\s]", " ", c.lower()).split()) for c in card.host]
    has = lambda column, cards: F.coalesce(F.exists(column, lambda c: _any([text.sanitized(c).contains(x) for x in cards])), F.lit(False)) if cards else F.lit(False)
    lineage, tags = _maybe(df, "source_lineage", "array<string>"), _maybe(df, "osm_tags", "array<string>")
    n = F.coalesce(F.size(lineage), F.lit(0))
    hits = reduce(lambda a, b: a + b, [(F.array_contains("evidence", t) | F.array_contains("category_tokens", t) | F.array_contains("web_tokens", t)).cast("int") for t in card.medium], F.lit(0))
    real = F.filter("evidence", lambda x: x != "<shop_word>")
    df = df.withColumns({
        "f_def_name": _defined_by_name(card).cast("double"), "f_def_cat": has(F.col("categories"), flat).cast("double"), "f_def_osm": has(tags, flat).cast("double"),
        "f_def_web": F.arrays_overlap("web_tokens", _texts(card.evidence_terms())).cast("double"), "f_sup_count": F.least(hits / 3, F.lit(1.0)), "f_host_cat": has(F.col("categories"), hosts).cast("double"),
        "f_nonev_only": ((F.size("non_evidence") > 0) & (F.size(real) == 0)).cast("double"), "f_cat_conf": F.coalesce(_maybe(df, "source_confidence", "double"), F.lit(0.5)),
        "f_src_agree": F.when(n > 1, F.least(n / 3, F.lit(1.0))).otherwise(0.0), "f_sem_pos": positive, "f_sem_neg": negative, "f_sem_margin": positive - negative, "f_ce": F.lit(ce),
    })
    df = held(df, [*[c for c in WEIGHTS if c in df.columns], *[c for c in ("reason_code", "edge_case") if c in df.columns]])
    return df.withColumn("f_name_only_primary", ((F.col("f_def_name") == 1) & (F.col("f_def_cat") == 0) & (F.col("f_def_osm") == 0) & (F.col("f_def_web") == 0)).cast("double"))


def scored(df: DataFrame, card: Concept, weights: dict[str, float] | None = None) -> DataFrame:
    """p, score_outcome (accepted, rejected, uncertain) and the three largest contributions."""
    weights = WEIGHTS | (weights or {})
    parts = {k: F.col(k) * w for k, w in weights.items()}
    p = stats.sigmoid(F.lit(BIAS) + reduce(lambda a, b: a + b, parts.values()))
    primary = (F.col("f_def_cat") == 1) | (F.col("f_def_osm") == 1) | (F.col("f_def_web") == 1)
    allowed = primary if card.require_defining else F.lit(True)
    outcome = F.when((F.col("p") >= card.tau_hi) & allowed, "accepted").when(F.col("p") >= card.tau_hi, "uncertain").when(F.col("p") < card.tau_lo, "rejected").otherwise("uncertain")
    return df.withColumn("p", p).withColumns({"score_outcome": outcome, "has_primary": primary, "top_reasons": top_contributions(parts)})


def decided(df: DataFrame, card: Concept, ring: list[tuple[float, float]] | None = None, excludes: tuple[str, ...] = (), force_review: bool = False, reranker: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """outcome, relevance_p, stage and code of each candidate.

    ``reranker`` is a column with a cross-encoder's score of the uncertain ones; without it they are for review.
    """
    rows = scored(features(hard_gates(df, card, ring, excludes), card), card, weights)
    gate, known = F.col("reason_code").isNotNull(), F.lit(not (force_review or card.synthesized))
    rescue = (F.col("f_sem_margin") >= 0.20) & (F.col("f_nonev_only") == 0)
    low = (F.col("score_outcome") == "rejected") & ~rescue
    result = lambda o, p, s, c: F.struct(F.lit(o).alias("outcome"), p.cast("double").alias("relevance_p"), F.lit(s).alias("stage"), c.cast("string").alias("code"))
    review = result("review", F.col("p"), "review_band", F.lit("uncertain_llm_disabled"))
    if reranker is not None:
        high, bad = reranker >= card.tau_hi, reranker <= card.tau_lo
        best, least = F.greatest(F.col("p"), reranker), F.least(F.col("p"), reranker)
        review = F.when(high & F.col("has_primary"), result("accepted", best, "cross_encoder", F.lit(None))).when(high, result("review", best, "cross_encoder", F.lit("ce_accepted_no_primary"))).when(bad, result("rejected", least, "cross_encoder", F.lit("cross_encoder_low"))).otherwise(result("review", F.col("p"), "review_band", F.lit("uncertain_llm_disabled")))
    decision = (
        F.when(gate, result("rejected", F.lit(0.0), "hard_gates", F.col("reason_code")))
        .when(~known, result("review", F.lit(0.5), "review_band", F.lit("concept_missing")))
        .when(F.col("score_outcome") == "accepted", result("accepted", F.col("p"), "scorer", F.lit(None)))
        .when(low, result("rejected", F.col("p"), "scorer", F.lit("low_evidence")))
        .otherwise(review)
    )
    told = rows.withColumn("_d", decision).select("*", "_d.*").drop("_d")
    return held(told, ["outcome", "relevance_p", "stage", "code"])


def one_pass(candidates: DataFrame, card: Concept, seen: DataFrame | None = None, **options) -> DataFrame:
    """Decisions of candidates that were not seen yet, each (source, id) once, the first by ``ordinal``."""
    w = Window.partitionBy("source", "source_record_id").orderBy("ordinal")
    fresh = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if seen is not None:
        fresh = fresh.join(seen.select("source", "source_record_id"), ["source", "source_record_id"], "left_anti")
    return decided(fresh, card, **options)


def degenerate(decisions: DataFrame) -> DataFrame:
    """Whether nothing at all was rejected of more than five."""
    return decisions.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "rejected").alias("rejected")).select("total", "rejected", ((F.col("total") > 5) & (F.col("rejected") == 0)).alias("degenerate"))


def fused(rows: DataFrame, a: str, b: str, by: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two scores over the candidates of each query (``by``)."""
    rank = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), "id"))
    return rows.withColumns({"_r1": rank(a), "_r2": rank(b)}).withColumn("fused", stats.fused_rank(F.col("_r1"), F.col("_r2"), k)).drop("_r1", "_r2")
