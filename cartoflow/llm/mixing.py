r"""Mixing sources to target weights without sorting documents.

Every document has a 60-bit hash of its id.  Sizes are summed by source and leading hash bits; the bucket in which a
source's running sum passes its budget is found, and only that bucket is summed again by further bits, until the
threshold is a single hash value.  A filter on the hash then takes the documents: any smaller budget takes a subset
(nested thresholds), and a rerun takes the same ones.

Targets: sources in order of code points, null last, weigh 5, 2, 1, 5, ... and share ``share`` of all words; a target
stops at ``cap`` times its source's size, and the excess goes to the others by weight until none is above.  A document
is taken floor(target / size of source) times, and once more if its hash is under the threshold of the rest; the last
document comes along if the sum is nearer to the budget with it.

Cases.  Null or empty text: size 0, taken 0.  Null source: a source of its own.  Null or repeated doc_id: rows of an
equal id share a hash and are taken or left together (null counts as the id ``<null>``).  Empty table: empty result.
Other columns are kept by ``mix`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import only, set_aside, spool

#: Bits of the hash, and how many of them each refinement looks at.
BITS, STEPS = 60, (12, 24, 60)
#: Rows of a source are dealt over so many keys when they meet the source's row.
SALTS = 64
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("<null>"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0) -> DataFrame:
    """From (source, source_size) rows: source, source_size, target.

    A source is at its cap exactly when cap * size / weight is below the common level; so, in order of that ratio, the
    capped ones come first, and the first prefix whose remaining level is not above the next ratio is the answer.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    rows = rows.withColumns({"budget": total * F.lit(float(share)), "w_left": weight - F.coalesce(F.sum("weight").over(before), F.lit(0)), "s_before": F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)), "rank": F.row_number().over(by_ratio)})
    # Capped iff the level that is left for this and later sources passes this one's cap.
    rows = rows.withColumn("capped", (F.col("budget") - F.col("s_before")) * F.col("weight") > F.lit(cap) * F.col("source_size") * F.col("w_left"))
    free = F.when(~F.col("capped"), F.struct("rank", "budget", "s_before", "w_left"))
    rows = rows.withColumn("first_free", F.min(free).over(everything))
    level = (F.col("first_free.budget") - F.col("first_free.s_before")) * F.col("weight") / F.col("first_free.w_left")
    at_cap = F.col("first_free").isNull() | (F.col("rank") < F.col("first_free.rank"))
    target = F.when(at_cap, (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(level.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def _salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many rows with one row a key, each key dealt over SALTS parts; null keys meet null keys."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64("u", "size"), F.lit(SALTS)))  # sizes part those of an equal id
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_s"))
    on = F.col("_salt") == F.col("_s")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, on, how).drop("_salt", "_s", *[f"_{k}" for k in keys])


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the least hash that is not taken: from rows (source, u, size) and budgets (source, rest)."""
    state = budgets.select("source", F.col("rest").cast("double"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = 0
    for bits in STEPS:
        shift = BITS - bits
        inside = rows if done == 0 else rows.withColumn("prefix", F.shiftright("u", BITS - done))
        # The boundary bucket alone is summed again.
        near = inside.select("source", "u", "size", *(["prefix"] if done else []))
        keys = ["source"] + (["prefix"] if done else [])
        if done:
            near = _salted(near, state.select("source", "prefix"), keys)
        sums = near.groupBy("source", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        sums = spool(sums)
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(running))
        at = sums.join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        # Twice the middle of a bucket's share, against twice the budget: monotone in the bucket.
        middle = 2 * (F.col("below") + F.col("upto")) - F.col("size")
        if shift:
            over = F.col("below") + F.col("upto") > F.col("rest")
            first = at.where(over).groupBy("source").agg(F.min(F.struct("bucket", (F.col("below") + F.col("upto") - F.col("size")).alias("before"))).alias("hit"))
        else:
            first = at.where(middle > 2 * F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", F.lit(0).cast("long").alias("before"))).alias("hit"))
        joined = state.join(first.select(F.col("source").alias("_source"), "hit"), F.col("source").eqNullSafe(F.col("_source")), "left")
        # No bucket passes the budget: everything summed here is below the threshold.
        state = spool(joined.select("source", "rest", F.coalesce(F.col("hit.bucket"), F.shiftleft(F.col("prefix") + 1, bits - done) if done else F.lit(1 << bits)).cast("long").alias("prefix"), F.coalesce("hit.before", "below").alias("below")))
        done = bits
    return state.select("source", F.col("prefix").alias("threshold"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Spooled rows (doc_id, source, u, size), and per source: source_size, target, times, threshold."""
    rows = only(docs, doc_id="doc_id", source="source", text="text")
    rows = spool(rows.select("doc_id", "source", hash60(F.col("doc_id")).alias("u"), n_words(F.col("text")).alias("size")))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, share)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = spool(goal.withColumn("times", times))
    limit = thresholds(rows, goal.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("rest")))
    goal = goal.join(limit.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return rows, spool(goal)


def copies(cap: int = 3) -> Column:
    return F.least(F.col("times") + F.when(F.col("u") < F.col("threshold"), 1).otherwise(0), F.lit(cap)).cast("long")


def mix_table(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    rows, goal = plan_mix(docs, weights, cap, share)
    out = _salted(rows, goal, ["source"])
    return out.select("doc_id", "size", "source_size", "target", (copies(cap) * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0) -> DataFrame:
    """The documents that the mix takes, all columns, with ``copies``: how often each is to be read (``copies_``, with as
    many underscores as it takes, where the documents have such a column)."""
    name = "copies"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    _, goal = plan_mix(docs, weights, cap, share)
    goal = goal.select(F.col("source").alias("_key"), F.struct("times", "threshold").alias("_goal"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_s"))
    docs, named = set_aside(docs, "doc_id", "source", "text")
    rows = docs.withColumn("_u", hash60(F.col("doc_id")))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_key")) & (F.pmod(F.xxhash64("_u", "text"), F.lit(SALTS)) == F.col("_s")))
    count = F.least(F.col("_goal.times") + F.when(F.col("_u") < F.col("_goal.threshold"), 1).otherwise(0), F.lit(cap)).cast("long")
    return named(rows.withColumn("_n", count).where("_n > 0").select(*docs.columns, F.col("_n").alias(name)))
