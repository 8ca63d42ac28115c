"""Child arrays, run metrics, shuffled controls and mutations on known rows."""

import pytest
from pyspark.sql import functions as F

from cartoflow.evaluate.metrics import mutated, run_metrics, shuffled_control
from cartoflow.operators.relational import with_children


def test_children(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    one = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 6, None), (9, 1, "z")], "of long, n int, v string")
    two = spark.createDataFrame([(2, 1.0)], "k long, w double")
    out = {r["id"]: r for r in with_children(parents, "id", {"ones": (one, "of", [F.desc("n")]), "twos": (two, "k", ["w"])}, {"ones": 2}).collect()}
    assert [tuple(x) for x in out[1]["ones"]] == [(7, "y"), (6, None)] and out[1]["twos"] == []
    assert [tuple(x) for x in out[2]["twos"]] == [(1.0,)] and out[3]["ones"] == [] and out[3]["name"] == "c"


def test_run_metrics(spark):
    schema = "run int, tier string, phones array<string>, emails array<string>, website_url string, website_domain string, address_text string, locality string, independent_source_count int, confidence double"
    rows = [(1, "Verified", ["1"], [], None, "d", None, "l", 2, 0.9), (1, None, None, ["e"], "u", None, "a", None, 1, None), (1, "Likely", [], None, None, None, None, None, None, 0.5), (2, "other", ["1"], ["2"], "u", "d", "a", "l", 3, None)]
    out = {r["run"]: r.asDict() for r in run_metrics(spark.createDataFrame(rows, schema), "run").collect()}
    assert out[1] == {"run": 1, "total": 3, "verified": 1, "likely": 1, "unverified": 1, "with_phone": 1, "with_email": 1, "with_website": 2, "with_address": 2, "multi_source": 1, "avg_confidence": 0.7}
    assert out[2]["avg_confidence"] == 0.0 and out[2]["unverified"] == 0
    assert run_metrics(spark.createDataFrame([], schema)).first()["total"] == 0


def test_shuffled_control(spark):
    """Dealing moves labels and keeps their number; a decision that is right always is no better than the base rate then."""
    rows = spark.range(4000).select("id", (F.col("id") % 4 == 0).alias("label"), (F.col("id") % 4 == 0).alias("accepted"))
    got = shuffled_control(rows).first()
    assert abs(got["precision_mean"] - 0.25) < 0.05 and 0 < got["precision_std"] < 0.05 and got["runs"] == 5
    same = shuffled_control(rows.withColumn("label", F.lit(True))).first()
    assert (same["precision_mean"], same["precision_std"]) == (1.0, 0.0)


def test_mutations_of_labels_need_labels(spark):
    rows = spark.createDataFrame([(1, True)], "id long, label boolean")
    assert mutated(rows, "inverted").first()["label"] is False
    for kind in ("inverted", "shuffled"):
        with pytest.raises(ValueError):
            mutated(rows.drop("label"), kind)
