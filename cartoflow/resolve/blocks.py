"""Blocks of entity resolution without their pairs: how many partners and links each row has, by classes and counts.

Rows that agree in all keys are a class, so a phone that a third of all rows has is one number and not pairs of pairs.
Partners over several keys are counted by inclusion and exclusion over groups of classes.  Only rows of one cell that share
neither phone nor domain need a look at their names; there, distinct (name, place) classes of a cell are paired when the
cell has FEW of them, and meet by segments of their names where it has more: a score of MATCH needs a likeness of
NAME_LEAST whatever the distance, so no link is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions import fuzzy, geo, text
from cartoflow.operators.typos import meeting
from cartoflow.resolve.entities import MATCH, location_score
from cartoflow.store.shared import spool

NAME_WEIGHT, PLACE_WEIGHT = 0.55, 0.45
NAME_LEAST = (MATCH - PLACE_WEIGHT) / NAME_WEIGHT
FEW = 64


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def blocks_of(rows: DataFrame, keys: dict[str, Column], id_: str = "id") -> DataFrame:
    """(id, class, <key>_of..., n_partners): the least id of the rows that agree in all keys and of those that share each
    key (null: none), and how many other rows share any.  Two rows are a pair where a <key>_of of both is the same."""
    named = rows.select(F.col(id_).alias("id"), *[c.cast("string").alias(k) for k, c in keys.items()])
    classes = spool(named.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("class")))
    total, out = F.lit(0), classes
    for size in range(1, len(keys) + 1):
        for some in combinations(keys, size):
            name = "n_" + "_".join(some)
            least = [F.min("class").alias(f"{some[0]}_of")] if size == 1 else []
            group = classes.dropna(subset=list(some)).groupBy(*some).agg((F.sum("n") - 1).alias(name), *least)
            out = out.join(group, list(some), "left")
            total = total + (1 if size % 2 else -1) * F.coalesce(F.col(name), F.lit(0))
    of = [f"{k}_of" for k in keys]
    out = out.select(*keys, "class", *of, total.cast("long").alias("n_partners"))
    return named.join(out, _same(named, out, list(keys))).select("id", "class", *of, "n_partners")


def partners(rows: DataFrame, keys: dict[str, Column], id_: str = "id") -> DataFrame:
    """(id, n_partners): other rows that share a value of any key; nulls share nothing."""
    return blocks_of(rows, keys, id_).select("id", "n_partners")


def _named(rows: DataFrame) -> DataFrame:
    name = F.array_join(F.array_sort(F.filter(F.split(text.business_name(F.col("name")), " +"), lambda w: w != "")), " ")
    return rows.select("id", name.alias("name"), "phone", "domain", "lon", "lat", geo.geohash(F.col("lon"), F.col("lat"), 7).alias("cell"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class), and (class, n, name, phone, domain, lon, lat, cell) of rows that agree in all of these; a class is
    known by its least id."""
    named = _named(rows)
    of = ["name", "phone", "domain", "lon", "lat", "cell"]
    classes = spool(named.groupBy(*of).agg(F.min("id").alias("class"), F.count("*").alias("n")))
    return named.join(classes, _same(named, classes, of)).select("id", "class"), classes


def class_links(classes: DataFrame, least: float = MATCH) -> DataFrame:
    """(a, b, probability), a < b: classes of one cell with neither phone nor domain in common that names and places link."""
    here = spool(classes.where("cell IS NOT NULL AND name IS NOT NULL"))
    names = here.groupBy("cell", "name").agg(F.count("*").alias("k"))
    sizes = names.groupBy("cell").agg(F.count("*").alias("names"))
    names = spool(names.join(sizes, "cell"))
    a, b = names.where(F.col("names") > FEW).select("cell", F.col("name").alias("a")), names.where(F.col("names") > FEW).select("cell", F.col("name").alias("b"))
    crowded = meeting(a, b, NAME_LEAST, None, ("cell",)).where("a < b")
    few = names.where(F.col("names") <= FEW)
    small = few.select("cell", F.col("name").alias("a")).join(few.select("cell", F.col("name").alias("b")), "cell").where("a < b")  # FEW names of a cell at most
    alike = crowded.union(small.select("cell", "a", "b")).withColumn("likeness", fuzzy.token_sort_ratio("a", "b")).where(F.col("likeness") >= NAME_LEAST - 1e-9)
    both = alike.union(names.select("cell", F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0))).union(alike.select("cell", F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    side = lambda s: here.select("cell", F.col("name").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("class", "phone", "domain", "lon", "lat")])
    met = side("a").join(both, ["cell", "a"]).join(side("b"), ["cell", "b"]).where("a_class < b_class")
    apart = ~(F.coalesce(F.col("a_phone") == F.col("b_phone"), F.lit(False)) | F.coalesce(F.col("a_domain") == F.col("b_domain"), F.lit(False)))
    metres = geo.flat_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    p = F.least(F.lit(1.0), NAME_WEIGHT * F.col("likeness") + PLACE_WEIGHT * location_score(metres))
    return met.where(apart).select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), p.alias("probability")).where(F.col("probability") >= least)


def name_links(rows: DataFrame) -> DataFrame:
    """(a, b, probability) for clusters, beside the links of phones and domains: each row with the least id of its name and
    place, and such places of one cell that names and places link.

    Classes of one name and place need no pairs: each two of them match, or have a phone or domain in common, which links
    them as well.
    """
    place = ["cell", "name", "lon", "lat"]
    known = _named(rows).where("cell IS NOT NULL AND name IS NOT NULL").select("id", *place)
    places = spool(known.groupBy(*place).agg(F.min("id").alias("class")))
    alone = places.withColumns({c: F.lit(None).cast("string") for c in ("phone", "domain")})
    members = known.join(places, place).where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("probability"))
    return class_links(alone).union(members)


def link_counts(rows: DataFrame, least: float = MATCH) -> DataFrame:
    """(id, class, n_shared, n_match): rows with a phone or domain in common, and others that name and place link."""
    members, classes = _classes(rows)
    links = spool(class_links(classes, least))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(classes.select(F.col("class").alias("b"), "n"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    # Rows of a class without phone and domain are linked by their one name and place.
    alone = F.when(F.col("phone").isNull() & F.col("domain").isNull() & F.col("cell").isNotNull() & F.col("name").isNotNull(), F.col("n") - 1).otherwise(0)
    matched = classes.join(other, "class", "left").select("class", (alone + F.coalesce("others", F.lit(0))).alias("n_match"))
    shared = partners(rows, {"phone": F.col("phone"), "domain": F.col("domain")}).withColumnRenamed("n_partners", "n_shared")
    return members.join(matched, "class").join(shared, "id").select("id", "class", "n_shared", "n_match")


def pair_scores(rows: DataFrame) -> DataFrame:
    """Every pair of a block with its probability, unexpanded: (kind, a, b, probability, n_shared, n_match).

    ``record`` rows have a row's class (a) and the numbers of its links; ``phone``, ``domain`` and ``place`` rows tell which
    rows (b) share a phone, a domain, or one name and place, by the least id (a) of those; ``pair`` rows hold two places of
    one cell, by those ids.  Of two rows the first of these holds that is true of both: same phone, domain or place (its
    probability), else that of the pair of their places.
    """
    plain, none = _named(rows), F.lit(None).cast("long")
    record = link_counts(rows).select(F.lit("record").alias("kind"), F.col("class").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("probability"), "n_shared", "n_match")

    def shared(kind: str, by: list[str], p: float) -> DataFrame:
        known = plain.dropna(subset=by)
        return known.join(known.groupBy(*by).agg(F.min("id").alias("a")), by).select(F.lit(kind).alias("kind"), "a", F.col("id").alias("b"), F.lit(p).alias("probability"), none.alias("n_shared"), none.alias("n_match"))

    place = ["cell", "name", "lon", "lat"]
    places = spool(plain.dropna(subset=place).groupBy(*place).agg(F.min("id").alias("id")))
    side = lambda s: places.select("cell", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "name", "lon", "lat")])
    metres = geo.flat_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    met = side("a").join(side("b"), "cell").where("a_id < b_id")
    p = F.least(F.lit(1.0), NAME_WEIGHT * fuzzy.token_sort_ratio("a_name", "b_name") + PLACE_WEIGHT * location_score(metres))
    pair = met.select(F.lit("pair").alias("kind"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), p.alias("probability"), none.alias("n_shared"), none.alias("n_match"))
    return record.union(shared("phone", ["phone"], 0.95)).union(shared("domain", ["domain"], 0.92)).union(shared("place", place, 1.0)).union(pair)


def bands(rows: DataFrame) -> DataFrame:
    """(band, n): pairs that share a key by what links them: ``shared``, ``match``, or nothing (``apart``)."""
    counts = link_counts(rows).agg((F.coalesce(F.sum("n_shared"), F.lit(0)) / 2).cast("long").alias("shared"), (F.coalesce(F.sum("n_match"), F.lit(0)) / 2).cast("long").alias("match"))
    keys = {"phone": F.col("phone"), "domain": F.col("domain"), "cell": geo.geohash(F.col("lon"), F.col("lat"), 7)}
    all_ = partners(rows, keys).agg((F.coalesce(F.sum("n_partners"), F.lit(0)) / 2).cast("long").alias("all"))
    both = counts.crossJoin(all_)  # a row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(k).alias("band"), c.alias("n")) for k, c in (("shared", F.col("shared")), ("match", F.col("match")), ("apart", F.col("all") - F.col("shared") - F.col("match")))]))).where("n > 0")
