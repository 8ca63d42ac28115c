"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartoflow.plans.analysis_queries import ranked
from cartoflow.plans.carriers import Tables


def ranked_entities(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(Tables(spark, folder))
