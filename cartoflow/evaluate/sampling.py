"""Label queues and blind samples, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(key: str, seed: object) -> Column:
    """A random order of keys that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def label_queue(rows: DataFrame, stratum: Column, key: str, limit: int, labelled: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """What is not labelled yet, by stratum and then by hash."""
    if labelled is not None:
        rows = rows.join(labelled.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return rows.withColumn("stratum", stratum).orderBy("stratum", dealt(key, seed), key).limit(limit)


def blind_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash (a smaller pool is drawn from again), under names that tell nothing."""
    order = [dealt(key, seed), F.col(key)]
    drawn = rows.orderBy(*order).limit(n)
    drawn = drawn.withColumns({"_i": F.row_number().over(Window.orderBy(*order)), "_n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    again = F.explode(F.sequence(F.col("_i").cast("long"), F.lit(n).cast("long"), F.col("_n")))
    return drawn.withColumn("_at", again).withColumn("blind_id", F.format_string("BLIND-%03d", F.col("_at"))).drop("_i", "_n", "_at")
