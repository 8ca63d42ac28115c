"""Streams of events: progress counts, filtered rows, and windows that the engine offers beyond its batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def accepted(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows that go out at once: a narrow filter, append mode."""
    return events.where(F.col("event_type").isin(*kinds))


def counters(events: DataFrame) -> DataFrame:
    """Running counts by kind; update or complete mode."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def tumbling(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_max(events: DataFrame, late: str = "10 minutes", size: str = "60 seconds", step: str = "5 seconds") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.max("value").alias("max_value"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events of one key once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def publish(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there to Parquet, batch by batch, and end; a restart goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def upsert_batches(rows: DataFrame, apply, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Hand each batch to ``apply(batch, number)``, which must give the same when a batch comes again."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).start()


def counted(events: DataFrame, run: str, every: int = 5) -> DataFrame:
    """Progress of runs, with a counter a run as state: a row whenever a run has passed a multiple of ``every`` events."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames, state: GroupState):
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        if now // every > before // every:
            yield pd.DataFrame({run: [key[0]], "evaluated": [now // every * every]})

    kind = events.schema[run].dataType.simpleString()
    return events.select(run).groupBy(run).applyInPandasWithState(step, f"{run} {kind}, evaluated long", "n long", "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, run: str, every: int = 5) -> DataFrame:
    """The batch form of progress: for each run, its count at every fifth event."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(run).orderBy("ts", "event_id"))
    return events.select(run, "event_id", at.cast("long").alias("evaluated")).where(F.col("evaluated") % every == 0)
