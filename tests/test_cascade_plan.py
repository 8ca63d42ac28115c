"""A decision is worked out once a row, whatever is asked of it."""

from cartoflow.plans.analysis_queries import GYM
from cartoflow.relevance import cascade


def test_a_filter_on_decisions_does_not_repeat_the_profile(spark, tmp_path):
    rows = [(1, "Iron Gym", ["gym"], "operational"), (2, "Divine Footwear", ["shoe_store"], None), (3, "Royal Hotel", ["hotel"], "permanently_closed"), (4, None, None, None)]
    spark.createDataFrame(rows, "id long, name string, categories array<string>, operating_status string").write.parquet(f"{tmp_path}/rows")
    out = cascade.decided(spark.read.parquet(f"{tmp_path}/rows"), GYM)
    accepted = out.where("outcome = 'accepted'").select("id")
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\w\\s]") < 20  # the pattern of a profile's words; it was there some hundred times
    assert [r["id"] for r in accepted.collect()] == [1]
    assert {r["id"]: (r["outcome"], r["code"]) for r in out.select("id", "outcome", "code").collect()} == {1: ("accepted", None), 2: ("rejected", "incompatible_category"), 3: ("rejected", "closed"), 4: ("review", "uncertain_llm_disabled")}
