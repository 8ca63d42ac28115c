"""Relational operators of the result store: filters, joins, aggregates, windows, set operations, upserts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.store.shared import spool


# --------------------------------------------------------------------------------------------------------- filters


@dataclass(frozen=True)
class Selection:
    """What a list, its counts and its export have in common.  None and () do not filter."""

    reachable_by: tuple[str, ...] = ()  # array columns that must not be empty: phones, emails
    name_has: str | None = None
    at_least: float | None = None  # confidence
    in_state: str | None = None  # decision
    in_tier: str | None = None
    of_run: int | None = None
    after_rank: int | None = None
    fresh: bool | None = None  # is_new
    leave_out: tuple[str, ...] = ()  # delivered, suppressed


def non_empty(column: Column) -> Column:
    return F.coalesce(F.size(column), F.lit(0)) > 0


def contains_ci(column: Column, text: str) -> Column:
    """Case-insensitive containment; % and _ of the text stand for themselves."""
    safe = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return column.ilike(f"%{safe}%")


def predicate(f: Selection, with_state: bool = True) -> Column:
    """The one conjunction behind list, counts and export: only the term of the state can be left out."""
    terms = [non_empty(F.col(c)) for c in f.reachable_by]
    equal = {"run_id": f.of_run, "tier": f.in_tier, "is_new": f.fresh, "decision": f.in_state if with_state else None}
    terms += [F.col(c) == v for c, v in equal.items() if v is not None]
    terms += [contains_ci(F.col("name"), f.name_has)] if f.name_has is not None else []
    terms += [F.col("rank") > f.after_rank] if f.after_rank is not None else []
    terms += [F.col("confidence") >= f.at_least] if f.at_least is not None else []
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def leads(results: DataFrame, businesses: DataFrame, f: Selection, delivered: DataFrame | None = None, suppression: DataFrame | None = None, with_state: bool = True) -> DataFrame:
    """Results with their businesses under the filters.  Predicates of one side go below the join by themselves."""
    rows = results.join(businesses, results["business_id"] == businesses["id"]).where(predicate(f, with_state))
    if "delivered" in f.leave_out and delivered is not None:
        rows = rows.join(delivered.select("business_id").distinct(), "business_id", "left_anti")
    if "suppressed" in f.leave_out and suppression is not None:
        rows = rows.join(suppressed_ids(businesses, suppression).withColumnRenamed("id", "business_id"), "business_id", "left_anti")
    return rows


def page(rows: DataFrame, limit: int, by: str = "rank", cursor: int | None = None) -> DataFrame:
    """Keyset page: a top-k, never a full sort."""
    rows = rows if cursor is None else rows.where(F.col(by) > cursor)
    return rows.orderBy(by).limit(limit)


def next_cursor(page_rows: DataFrame, limit: int, by: str = "rank") -> DataFrame:
    """The last key of a full page, null of any other."""
    return page_rows.agg(F.when(F.count("*") == limit, F.max(by)).alias("next_cursor"))


def fill_up(first: DataFrame, second: DataFrame, limit: int, by: str) -> DataFrame:
    """Rows of the first up to the limit, the rest from the second."""
    both = first.withColumn("_turn", F.lit(0)).unionByName(second.withColumn("_turn", F.lit(1)))
    return both.orderBy("_turn", by).limit(limit).drop("_turn")


# ----------------------------------------------------------------------------------------------------------- joins


def suppressed_ids(businesses: DataFrame, suppression: DataFrame) -> DataFrame:
    """Ids of businesses that any of phone, domain or mail suppresses, each once.

    Three alternatives would make the join a nested loop; keys of one (kind, value) form make it one hash join.
    """
    tagged = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    keys = businesses.select("id", F.explode(F.concat(tagged("phone", "phones"), tagged("email", "emails"), F.array(F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value"))))).alias("k")).select("id", "k.kind", "k.value").where("value is not null")
    listed = suppression.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("phone", "phone"), ("email", "email"), ("domain", "domain"))]))).where("value is not null").distinct()
    return keys.join(listed, ["kind", "value"], "left_semi").select("id").distinct()


def _near_points(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(x1, y1, x2, y2, metres) of distinct points within a distance, by grid cells and an exact test.

    Cells are a little larger than the distance.  East-west a degree shrinks with latitude, so every row of cells has a
    width of its own, and a point looks for itself in the three rows about it by their widths; columns wrap at 180 degrees.
    """
    from cartoflow.functions.geo import haversine_m

    size = metres / 110_000.0
    row = lambda y: F.floor(y / size)

    def columns(r: Column) -> Column:
        """How many cells go round the earth in a row: of the width that its end nearer to a pole needs."""
        far = F.least(F.greatest(F.abs(r), F.abs(r + 1)) * size, F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0 / size) * F.cos(F.radians(far)))).cast("long")

    column = lambda x, n: F.least(F.floor((F.pmod(x + 180.0, F.lit(360.0))) / 360.0 * n), n - 1).cast("long")
    a = left.select(F.col("lon").alias("x1"), F.col("lat").alias("y1")).distinct().withColumn("cy", row(F.col("y1")))
    a = a.withColumn("cx", column(F.col("x1"), columns(F.col("cy"))))
    b = right.select(F.col("lon").alias("x2"), F.col("lat").alias("y2")).distinct().withColumn("dy", F.explode(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)]))).withColumn("cy", row(F.col("y2")) + F.col("dy")).drop("dy")
    b = b.withColumn("_n", columns(F.col("cy")))
    here = column(F.col("x2"), F.col("_n"))
    around = F.array_distinct(F.array(*[F.pmod(here + i, F.col("_n")) for i in (-1, 0, 1)]))
    b = b.withColumn("cx", F.explode(around)).drop("_n")
    return a.join(b, ["cx", "cy"]).withColumn("metres", haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).where(F.col("metres") <= metres).select("x1", "y1", "x2", "y2", "metres")


def near_pairs(left: DataFrame, right: DataFrame, metres: float, at_most: int | None = None) -> DataFrame:
    """Pairs (left_id, right_id, metres) of points within a distance; with ``at_most`` the nearest of each left row.

    Rows of one point are measured once.  Of them no more than ``at_most`` come into any answer, those of least ids.
    """
    near = spool(_near_points(left, right, metres))
    mine = left.select(F.col("id").alias("left_id"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    theirs = right.select(F.col("id").alias("right_id"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    if at_most is None:
        return mine.join(near, ["x1", "y1"]).join(theirs, ["x2", "y2"]).select("left_id", "right_id", "metres")
    best = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("metres", 6), "right_id"))).where(F.col("_n") <= at_most).drop("_n")
    first = theirs.withColumn("_n", F.row_number().over(Window.partitionBy("x2", "y2").orderBy("right_id"))).where(F.col("_n") <= at_most).drop("_n")
    found = spool(best(near.join(first, ["x2", "y2"]).select("x1", "y1", "right_id", "metres"), "x1", "y1"))
    return best(mine.join(found, ["x1", "y1"]).select("left_id", "right_id", "metres"), "left_id")


def near_counts(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(id, n): how many right rows are within a distance of each left row that has any, without their pairs."""
    sizes = right.groupBy(F.col("lon").alias("x2"), F.col("lat").alias("y2")).agg(F.count("*").alias("n"))
    of = spool(_near_points(left, right, metres).join(sizes, ["x2", "y2"]).groupBy("x1", "y1").agg(F.sum("n").alias("n")))
    return left.select("id", F.col("lon").alias("x1"), F.col("lat").alias("y1")).join(of, ["x1", "y1"]).groupBy("id").agg(F.sum("n").alias("n"))


def near_named(new: DataFrame, store: DataFrame, metres: float) -> DataFrame:
    """(id, match_id): the least entry of the store within a distance whose name has the other's, or the other way round.

    Rows of one name and point are a class; only classes are compared."""
    of = lambda df, i: df.where("name is not null").select("id", F.lower("name").alias(f"name{i}"), F.col("lon").alias(f"x{i}"), F.col("lat").alias(f"y{i}"))
    mine = of(new, 1)
    theirs = of(store, 2).groupBy("name2", "x2", "y2").agg(F.min("id").alias("match_id"))
    near = _near_points(new.where("name is not null"), store.where("name is not null"), metres)
    met = mine.drop("id").distinct().join(near, ["x1", "y1"]).join(theirs, ["x2", "y2"]).where(F.col("name1").contains(F.col("name2")) | F.col("name2").contains(F.col("name1")))
    best = spool(met.groupBy("name1", "x1", "y1").agg(F.min("match_id").alias("match_id")))
    return mine.join(best, ["name1", "x1", "y1"]).select("id", "match_id")


def staged_match(new: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """For each id the match of the earliest stage that has one, its least; stages are (id, match_id)."""
    found = reduce(DataFrame.unionByName, [s.select("id", "match_id", F.lit(i).alias("stage")) for i, s in enumerate(stages, 1)])
    best = found.groupBy("id").agg(F.min(F.struct("stage", "match_id")).alias("m")).select("id", "m.match_id", "m.stage")
    return new.join(best, "id", "left")


def blocked_pairs(rows: DataFrame, keys: dict[str, Column], id_: str = "id") -> DataFrame:
    """Pairs (a, b), a < b, of rows that share a value of any key, each once."""
    blocks = rows.select(F.col(id_).alias("_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in keys.items()])).alias("k")).select("_id", "k.kind", "k.value").where("value is not null")
    return blocks.withColumnRenamed("_id", "a").join(blocks.withColumnRenamed("_id", "b"), ["kind", "value"]).where("a < b").select("a", "b").distinct()


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list]], most: dict[str, int] | None = None) -> DataFrame:
    """Parents with an array of structs for each child table, empty where there are none.

    children: by name, (rows, column that is the parent's key, order); ``most`` bounds an array to its first rows, which are
    then chosen before anything is gathered.
    """
    out = parents
    for name, (rows, of, order) in children.items():
        by = Window.partitionBy(of).orderBy(*order)
        rows = rows.withColumn("_at", F.row_number().over(by))
        if most and name in most:
            rows = rows.where(F.col("_at") <= most[name])
        fields = [c for c in rows.columns if c not in (of, "_at")]
        lists = rows.groupBy(F.col(of).alias("_of")).agg(F.sort_array(F.collect_list(F.struct("_at", F.struct(*fields).alias("row")))).alias(name))
        lists = lists.select("_of", F.transform(name, lambda x: x["row"]).alias(name))
        out = out.join(lists, F.col(key) == F.col("_of"), "left").drop("_of")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """For each of a bounded set of query vectors (id, embedding) the k rows of highest cosine, of ``least`` or more.

    Queries are broadcast (they are a stated, small set); the best k are kept a partition before they meet.
    """
    from cartoflow.functions.stats import cosine

    q = F.broadcast(queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("_q")))
    scored = vectors.select(F.col("id").alias("vec_id"), F.col("embedding").alias("_v")).join(q, F.lit(True)).select("query_id", "vec_id", F.round(cosine(F.col("_q"), F.col("_v")), 6).alias("similarity")).where(F.col("similarity") >= least)
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("position", F.row_number().over(by)).where(F.col("position") <= k)


# ------------------------------------------------------------------------------------------------------ aggregates


def merged_counters(maps: DataFrame, key: str, counters: str) -> DataFrame:
    """Counters of several maps summed by name, per key."""
    return maps.select(key, F.explode(counters).alias("name", "value")).groupBy(key, "name").agg(F.sum("value").cast("long").alias("value"))


def rates(total: Column, **counts: Column) -> list[Column]:
    return [F.round(c / F.greatest(F.lit(1.0), total), 3).alias(name) for name, c in counts.items()]


# --------------------------------------------------------------------------------------------------------- windows


def ranked(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of an order, numbered: the order is a top-k, and only that many rows are numbered in one task."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def trailing_max(rows: DataFrame, key: str, at: Column, value: str, span: int) -> DataFrame:
    """Rows with trailing_max: the largest value of their key from ``span`` before to now.

    Time is cut to blocks of the span.  Rows go to their block, and to the next one to be seen there; windows are within
    (key, block), so a key that most rows have is spread over as many tasks as it has blocks.
    """
    rows = rows.withColumns({"_at": at, "_block": F.floor(at / span)})
    old = rows.select(key, value, "_at", (F.col("_block") + 1).alias("_block"), F.lit(True).alias("_old"))
    both = rows.withColumn("_old", F.lit(False)).unionByName(old, allowMissingColumns=True)
    w = Window.partitionBy(key, "_block").orderBy("_at").rangeBetween(-span, 0)
    return both.withColumn("trailing_max", F.max(value).over(w)).where("not _old").drop("_at", "_block", "_old")


def throttled(rows: DataFrame, key: str, order: str, latency: Column, ok: Column, start: float, least: float, most: float) -> DataFrame:
    """The delay after each key's requests in order: half way to the latency when it went well, never less than now when
    it did not, and never outside the bounds."""
    seen = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), latency.cast("double").alias("x"), ok.alias("ok"))))
    half = lambda a, b: (a + b) / 2
    step = lambda d, r: F.least(F.lit(most), F.greatest(F.lit(least), F.when(r["ok"], half(d, r["x"])).otherwise(F.greatest(d, half(d, 2 * r["x"])))))
    return rows.groupBy(key).agg(F.aggregate(seen, F.lit(start), step).alias("delay"))


# ---------------------------------------------------------------------------------------------------------- stores


def upsert(old: DataFrame, new: DataFrame, keys: list[str], choose: dict[str, str]) -> DataFrame:
    """Old rows with new ones: per column ``new`` (overwrite), ``keep`` (old one first), ``fill`` (new one unless null),
    ``greatest`` or ``least``; columns without a rule are overwritten.  ``tier`` rules name the column that decides, as
    ``with:confidence``: the side with the higher one, the new side on ties."""
    n, o = new.select([F.col(c).alias(f"n_{c}") for c in new.columns] + [F.lit(True).alias("_n")]), old.select([F.col(c).alias(f"o_{c}") for c in old.columns] + [F.lit(True).alias("_o")])
    on = reduce(lambda a, b: a & b, [F.col(f"n_{k}") == F.col(f"o_{k}") for k in keys])
    both = n.join(o, on, "full_outer")
    fresh, had = F.col("_n").isNotNull(), F.col("_o").isNotNull()

    def column(c: str) -> Column:
        a, b, rule = F.col(f"n_{c}"), F.col(f"o_{c}"), choose.get(c, "new")
        if rule == "keep":
            merged = b
        elif rule == "fill":
            merged = F.coalesce(a, b)
        elif rule in ("greatest", "least"):
            merged = getattr(F, rule)(a, b)
        elif rule.startswith("with:"):
            by = rule[5:]
            merged = F.when(F.coalesce(F.col(f"n_{by}") >= F.col(f"o_{by}"), F.lit(True)), a).otherwise(b)
        else:
            merged = a
        return F.when(fresh & had, merged).when(fresh, a).otherwise(b).alias(c)

    return both.select(*[column(c) for c in new.columns])


def last_write_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_of(rows, keys, order)


def schema_gaps(df: DataFrame, required: set[str]) -> list[str]:
    return sorted(required - set(df.columns))


def require_columns(df: DataFrame, required: set[str]) -> DataFrame:
    missing = schema_gaps(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
