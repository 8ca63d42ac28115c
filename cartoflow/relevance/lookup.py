"""Keywords resolved against a large dictionary, as tables: every stage is an equality join, and the best stage wins.

Shared words meet by an inverted index.  Typos are looked for in packs (``cartoflow.operators.packs``): labels that are made of
the same words have segments in common with nearly all others, and of them only the most like is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.operators.packs import LETTERS, best_entries
from cartoflow.operators.similar import like_pairs
from cartoflow.operators.typos import LEAST, MOST_APART, typo_pairs
from cartoflow.store.shared import spool


def _stemmed(text: Column) -> Column:
    return F.when(text.endswith("ies"), F.regexp_replace(text, "ies$", "y")).otherwise(F.regexp_replace(text, "(?<!s)s$", ""))


def resolved(keywords: DataFrame, concepts: DataFrame, least: float = LEAST) -> DataFrame:
    """(keyword, concept_id, confidence, way) of distinct keywords; concepts are (position, concept_id, labels, strong,
    defining), of any number.

    Ways in order: ``exact`` (the id, plural or not), ``alias``, ``fuzzy``, ``tokens`` (three quarters of all words shared),
    ``taxonomy`` (a word of a category that defines the concept), ``unresolved``.  Of equal aliases the last concept's
    counts; of equally like ones the greatest alias; of concepts by a category the first.
    """
    text = F.trim(F.regexp_replace(F.lower(F.trim("keyword")), r"\s+", " "))
    asked = spool(keywords.select("keyword").where("keyword IS NOT NULL").distinct().withColumn("text", text).withColumn("stem", _stemmed(F.col("text"))))
    forms = asked.select("keyword", F.posexplode(F.array("text", "stem")).alias("turn", "form"))

    ids = concepts.select("concept_id", F.regexp_replace("concept_id", "_", " ").alias("form")).where(~F.col("concept_id").contains(" "))
    order = F.struct("position", "kind", "at")
    said = lambda kind, c: concepts.select("position", "concept_id", F.lit(kind).alias("kind"), F.posexplode(c).alias("at", "alias"))
    aliases = spool(said(0, "strong").union(said(1, "labels")).groupBy(F.lower("alias").alias("alias")).agg(F.max_by("concept_id", order).alias("concept_id")))

    stage = lambda df, rank, way, confidence, best: df.select("keyword", F.lit(rank).alias("rank"), best.alias("best"), "concept_id", confidence.alias("confidence"), F.lit(way).alias("way"))
    number = lambda x: F.struct(x.cast("double").alias("x"), F.lit("").alias("s"))
    exact = stage(forms.withColumn("form", F.regexp_replace("form", "_", " ")).join(ids, "form"), 1, "exact", F.lit(1.0), number(-F.col("turn")))
    alias = stage(forms.join(aliases, F.col("form") == F.col("alias")), 2, "alias", F.lit(0.95), number(-F.col("turn")))
    # Only what the first two stages leave goes on to the dear ones.
    early = spool(exact.union(alias))
    rest = spool(asked.join(early, "keyword", "left_anti"))

    typos = best_entries(rest.select(F.col("text").alias("a")), aliases.select(F.col("alias").alias("b")), least, MOST_APART).toDF("keyword", "entry", "likeness")
    typos = typos.union(typo_pairs(rest.select(F.col("text").alias("keyword")).where(F.length("keyword") > LETTERS), aliases.select(F.col("alias").alias("entry")).where(F.length("entry") > LETTERS - MOST_APART), least))
    typos = typos.select(F.col("keyword").alias("text"), F.col("entry").alias("alias"), "likeness").join(rest, "text").join(aliases, "alias")
    fuzzy = stage(typos, 3, "fuzzy", F.col("likeness"), F.struct(F.col("likeness").alias("x"), F.col("alias").alias("s")))

    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    sets = lambda df, c: df.select(F.col(c).alias("class"), words(F.col(c)).alias("grams")).where("size(grams) > 0")
    shared = like_pairs(sets(rest, "text").distinct(), sets(aliases, "alias"), 0.75, by_size=True).select(F.col("a").alias("text"), F.col("b").alias("alias"), "likeness").join(rest, "text").join(aliases, "alias")
    tokens = stage(shared, 4, "tokens", F.col("likeness"), F.struct(F.col("likeness").alias("x"), F.col("alias").alias("s")))

    category = concepts.select("position", "concept_id", F.explode("defining").alias("d")).select("position", "concept_id", F.explode(F.split("d", r"[_\W]+")).alias("word")).where("word <> ''")
    category = category.groupBy("word").agg(F.min_by("concept_id", "position").alias("concept_id"), F.min("position").alias("position"))
    taxonomy = stage(rest.select("keyword", F.explode(words(F.col("text"))).alias("word")).join(category, "word"), 5, "taxonomy", F.lit(0.6), number(-F.col("position")))

    found = early.union(fuzzy).union(tokens).union(taxonomy)
    best = found.groupBy("keyword").agg(F.max_by(F.struct("concept_id", "confidence", "way"), F.struct((-F.col("rank")).alias("r"), "best")).alias("b"))
    return asked.select("keyword").join(best, "keyword", "left").select("keyword", "b.concept_id", F.coalesce("b.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("b.way", F.lit("unresolved")).alias("way"))
