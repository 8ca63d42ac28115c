"""Pairs of strings that are alike, by segments: nothing is compared but what shares a piece in the right place.

Likeness is twice the matched characters over both lengths (sequence and indel ratios).  Matched characters are a common
subsequence, so a pair of lengths allows a known number e of letters that are left out on either side.  One string is cut to
e + 1 segments: one of them is whole in the other, moved by e places at most.  Segments are hash-joined with the other side's
pieces, by both lengths, number and (if asked) a block; the measure itself runs on what meets.  (All deletions of e letters
would do the same with some thousand strings for a name of sixteen letters; segments are a few tens.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.functions.fuzzy import sequence_ratio

LEAST, MOST_APART = 0.78, 4


def _left_out(la: Column, lb: Column, least: float) -> Column:
    """Letters that strings of these lengths may have besides the matched ones; -1 where they cannot be so like."""
    matched = F.ceil(F.lit(least / 2) * (la + lb) - 1e-9).cast("int")
    return F.when(matched <= F.least(la, lb), la + lb - 2 * matched).otherwise(F.lit(-1))


def _lengths(n: Column, least: float, apart: int | None) -> Column:
    """Lengths of what may be so like a string of length n (whole numbers near the bounds are let in)."""
    lo, hi = F.ceil(n * (least / (2 - least)) - 1e-9).cast("int"), F.floor(n * ((2 - least) / least) + 1e-9).cast("int")
    if apart is not None:
        lo, hi = F.greatest(lo, n - apart), F.least(hi, n + apart)
    return F.sequence(F.greatest(lo, F.lit(1)), F.greatest(hi, F.lit(1)))


def segments(text: Column, least: float, apart: int | None = None) -> Column:
    """An entry's segments, for each length of keyword."""
    lb = F.length(text)

    def of(la: Column) -> Column:
        e = _left_out(la, lb, least)
        at = lambda i: F.floor(i * lb / (F.greatest(e, F.lit(0)) + 1)).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.greatest(e, F.lit(0))), lambda i: F.struct(la.alias("la"), lb.alias("lb"), i.alias("i"), F.substring(text, at(i) + 1, at(i + 1) - at(i)).alias("piece")))
        return F.filter(each, lambda x: e >= 0)

    return F.flatten(F.transform(_lengths(lb, least, apart), of))


def pieces(text: Column, least: float, apart: int | None = None) -> Column:
    """A keyword's pieces where segments of an entry may be, for each length of entry."""
    la = F.length(text)

    def of(lb: Column) -> Column:
        e = _left_out(la, lb, least)
        at = lambda i: F.floor(i * lb / (F.greatest(e, F.lit(0)) + 1)).cast("int")

        def moved(i: Column) -> Column:
            size = at(i + 1) - at(i)
            lo, hi = F.greatest(at(i) - e, F.lit(0)), F.least(at(i) + e, la - size)
            each = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda p: F.struct(la.alias("la"), lb.alias("lb"), i.alias("i"), F.substring(text, p + 1, size).alias("piece")))
            return F.filter(each, lambda x: hi >= lo)

        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(e, F.lit(0))), moved)), lambda x: e >= 0)

    return F.flatten(F.transform(_lengths(la, least, apart), of))


def meeting(left: DataFrame, right: DataFrame, least: float, apart: int | None = None, block: tuple[str, ...] = ()) -> DataFrame:
    """(block..., a, b), each once: strings of the columns ``a`` and ``b`` that can be at least so like."""
    a = left.where("length(a) > 0").select(*block, "a", F.inline(pieces(F.col("a"), least, apart)))
    b = right.where("length(b) > 0").select(*block, "b", F.inline(segments(F.col("b"), least, apart)))
    return a.join(b, [*block, "la", "lb", "i", "piece"]).select(*block, "a", "b").distinct()


def typo_pairs(keywords: DataFrame, entries: DataFrame, least: float = LEAST, apart: int | None = MOST_APART) -> DataFrame:
    """(keyword, entry, likeness) of two columns of strings, each distinct, that are at least so like."""
    met = meeting(keywords.select(F.col("keyword").alias("a")).distinct(), entries.select(F.col("entry").alias("b")).distinct(), least, apart)
    met = met.select(F.col("a").alias("keyword"), F.col("b").alias("entry"))
    return met.withColumn("likeness", sequence_ratio("keyword", "entry")).where(F.col("likeness") >= least)
