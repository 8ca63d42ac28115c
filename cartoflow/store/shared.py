"""Tables of the shared folder: what later rounds read without computing it again, and lost executors do no harm to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors see, under spark.checkpoint.dir; a local one only where that is unset and
    the session is local too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/cartoflow-checkpoints"
    return f"{root.rstrip('/')}/cartoflow-{uuid.uuid4().hex}"


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
