"""Why a decision is as it is: chips and the largest contributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (part of a code, type, label): the first that a code has.
RULES = (("closed", "reject", "Closed"), ("outside_boundary", "reject", "Outside the area"), ("user_exclude", "reject", "Excluded"), ("incompatible", "reject", "Other kind of business"), ("veto", "reject", "Says otherwise"), ("low_evidence", "reject", "Too little evidence"), ("def_cat", "accept", "Category"), ("def_osm", "accept", "Map tag"), ("def_web", "accept", "Website"), ("def_name", "accept", "Name"), ("review", "review", "For review"), ("concept_missing", "review", "Unknown concept"))


def chip(code: Column, rules: tuple[tuple[str, str, str], ...] = RULES, other: tuple[str, str] = ("info", "Signal")) -> Column:
    """struct(type, label): of the first rule whose text the code has."""
    kind, label = F.lit(other[0]), F.lit(other[1])
    for part, k, text in reversed(rules):
        kind, label = F.when(code.contains(part), k).otherwise(kind), F.when(code.contains(part), text).otherwise(label)
    return F.struct(kind.alias("type"), label.alias("label"))


def top_contributions(values: dict[str, Column], n: int = 3) -> Column:
    """The n contributions of largest size, names in order on ties."""
    rows = F.array(*[F.struct((-F.abs(v)).cast("double").alias("o"), F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in values.items()])
    return F.transform(F.slice(F.array_sort(rows), 1, n), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
