"""A corpus pipeline: five stages over ``documents``, each one of the operators of ``cartoflow.llm``.

A stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of ``documents``; the last
one adds ``copies``, how often the mix reads a document (with underscores where the documents have such a column).  Stages meet by Parquet in the shared folder.

Null and empty texts, repeated rows, empty tables and extra columns: as each operator's module states; extra columns stay.
Documents with null or empty text go in the first stage (too few words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartoflow.llm import decontaminate, mixing, quality, simhash, suffixes
from cartoflow.llm.common import spool


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base conditions, or that the rules' posterior is against, go."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash balls over five-word shingles find, and a Jaccard similarity of 0.8 and
    more links, the one with the least doc_id stays."""
    return simhash.deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier go."""
    return suffixes.cleaned(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark windows go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, and how often."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
]

#: The quality model, SimHash links and suffix arrays have no SQL.  Tests hold near-duplicates, suffix dedup and
#: decontamination against brute force, mixing against its targets, and the whole on one small table of planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir))
    return docs
