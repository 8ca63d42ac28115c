"""Scalar statistics, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, bound: float = 15.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine moved to 0 .. 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def wilson(successes: Column, n: Column, z: float = 1.96, empty: tuple[float, float] = (0.0, 1.0)) -> Column:
    """struct(low, high): Wilson's interval; ``empty`` where n is 0."""
    p = successes / F.greatest(n, F.lit(1))
    d = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / d
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.struct(F.when(n > 0, low).otherwise(empty[0]).alias("low"), F.when(n > 0, high).otherwise(empty[1]).alias("high"))


def rule_of_three(n: Column) -> Column:
    return F.lit(3.0) / F.greatest(n, F.lit(1))


def permutation_p(at_least: Column, n: Column) -> Column:
    """The share of a null sample that reaches a value, both counted with the value itself."""
    return (at_least + 1) / (n + 1)


def chapman(n1: Column, n2: Column, both: Column) -> Column:
    """Estimated population of two captures; null where one is empty."""
    return F.when((n1 > 0) & (n2 > 0), F.floor((n1 + 1) * (n2 + 1) / (both + 1) - 1).cast("long"))


def fused_rank(rank1: Column, rank2: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion of two ranks, 1 for the first of both."""
    return F.least(F.lit(1.0), (1.0 / (k + rank1) + 1.0 / (k + rank2)) / F.lit(2.0 / (k + 1)))
