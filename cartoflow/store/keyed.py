"""A stored table with keys: upserts that rewrite only the buckets of the keys they bring, and may be run again.

Rows lie in hash buckets of their key, a partition each.  An upsert folds its rows to one a key, reads the buckets it
touches, merges by rules and puts those buckets in the old ones' place (dynamic partition overwrite); the others are not even
listed.  Each row says which batch wrote it last: when a batch is run again, after a failure half-way or by mistake, rows that
it has written already stay as they are, so rules that are not idempotent are safe too.  Counts come from the write itself.

One writer at a time.  Keys are not null; a null one raises before anything is written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartoflow.operators.relational import upsert
from cartoflow.store.shared import spool

BUCKET, BATCH = "_bucket", "_batch"


def folded(rows: DataFrame, keys: list[str], choose: dict[str, str], order: list[Column]) -> DataFrame:
    """One row a key, as if the rows were upserted one after the other in this order (partial sums before the shuffle)."""
    turn = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])

    def column(c: str) -> Column:
        rule = choose.get(c, "new")
        if rule == "fill":
            return F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(c)
        if rule in ("greatest", "least"):
            return (F.max if rule == "greatest" else F.min)(c).alias(c)
        if rule.startswith("with:"):
            return F.max_by(c, F.struct(F.col(rule[5:]).alias("by"), turn.alias("turn"))).alias(c)
        return (F.min_by if rule == "keep" else F.max_by)(c, turn).alias(c)

    return rows.groupBy(*keys).agg(*[column(c) for c in rows.columns if c not in keys])


class KeyedTable:
    """A table at ``path``; ``choose`` has the columns' rules as in ``operators.relational.upsert``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], choose: dict[str, str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.choose, self.buckets = spark, path.rstrip("/"), keys, choose or {}, buckets
        try:
            known = spark.read.schema("keys array<string>, buckets int").json(f"{self.path}/_meta").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None
        if known is None:
            spark.createDataFrame([(keys, buckets)], "keys array<string>, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.path}/_meta")
        elif (known["keys"], known["buckets"]) != (keys, buckets):
            raise ValueError(f"{path} has keys {known['keys']} in {known['buckets']} buckets")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _stored(self, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, {BATCH} string, {BUCKET} int").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, {BATCH} string, {BUCKET} int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(BUCKET, BATCH)

    def get(self, wanted: DataFrame) -> DataFrame:
        """The stored rows of some keys: the bucket is part of the join, so other partitions are pruned."""
        asked = wanted.select(*self.keys).distinct().withColumn(BUCKET, self.bucket())
        return self.spark.read.parquet(self.path).join(asked, [*self.keys, BUCKET], "left_semi").drop(BUCKET, BATCH)

    def upsert(self, rows: DataFrame, batch: str, order: list[Column] | None = None) -> dict[str, int]:
        """Numbers of keys that were new, and that were there.  ``order`` says which of several rows of a key comes last."""
        columns = rows.columns
        new = spool((folded(rows, self.keys, self.choose, order) if order else rows.dropDuplicates(self.keys)).withColumn(BUCKET, self.bucket()).select(*columns, BUCKET))
        bad = new.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).limit(1).count()
        if bad:
            raise ValueError(f"null key in batch {batch}")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # `buckets` at most
        if not touched:
            return {"inserted": 0, "updated": 0}
        old = self._stored(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)).where(F.col(BUCKET).isin(touched))
        again = old.where(F.col(BATCH) == batch).select(*self.keys, BUCKET)
        fresh = new.join(again, [*self.keys, BUCKET], "left_anti").select(*columns, F.lit(batch).alias(BATCH), BUCKET)
        flag = lambda df, was: df.withColumns({"_had": F.lit(True) if was else F.lit(None).cast("boolean"), "_came": F.lit(None).cast("boolean") if was else F.lit(True)})
        merged = upsert(flag(old.select(*columns, BATCH, BUCKET), True), flag(fresh, False), [*self.keys, BUCKET], self.choose | {"_had": "fill"})
        seen = Observation()
        had = F.coalesce("_had", F.lit(False))
        merged = merged.observe(seen, F.count_if(F.col("_came") & ~had).alias("inserted"), F.count_if(F.col("_came") & had).alias("updated"))
        out = merged.select(*columns, BATCH, BUCKET).repartition(min(len(touched), self.buckets), BUCKET)
        out.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        return {k: int(v) for k, v in seen.get.items()}


def append_batch(rows: DataFrame, path: str, batch: str) -> int:
    """Append rows as a batch of a Parquet table, and say how many.  A batch that is run again takes its own place.  What the
    write has seen must be what the batch's files hold (their footers are read, not the table)."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(BATCH, F.lit(batch)).write.partitionBy(BATCH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    n = int(seen.get["n"])
    there = rows.sparkSession.read.schema(f"{BATCH} string").parquet(path).where(F.col(BATCH) == batch).count() if n else 0
    if there != n:
        raise RuntimeError(f"{path}: {n} rows were to be appended as {batch}, {there} were")
    return n
