"""The language model is fitted on every training document, however large the corpus."""

import subprocess
import sys
from pathlib import Path

from cartoflow.llm import lm


def test_fit_reads_all_training_documents(spark, monkeypatch):
    rows = [(i, f"word{i} and some other words of document {i % 17}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "PASSES", 1)  # as in a corpus that has more subwords than this
    seen, trained = [], lm.trained

    def told(fitted, *rest):
        seen.append({r["key"] for r in fitted.select("key").collect()})
        return trained(fitted, *rest)

    monkeypatch.setattr(lm, "trained", told)
    out = lm.scored(docs).collect()
    assert len(seen[0]) == sum(not r["held_out"] for r in out) < 400


def test_a_document_is_cut_to_subwords_in_one_round(spark, monkeypatch):
    """Rounds share out the training documents: none is missed, and none is dealt twice."""
    docs = spark.createDataFrame([(i, f"word{i} and some other words of document {i % 17}") for i in range(200)], "doc_id long, text string")
    seen, trained = [], lm.trained

    def told(fitted, counts, rates, turn):
        every = sorted(r["key"] for r in fitted.select("key").collect())
        rounds = [[r["key"] for r in turn(i, len(rates)).select("key").collect()] for i in range(len(rates))]
        seen.append((every, rounds))
        return trained(fitted, counts, rates, turn)

    monkeypatch.setattr(lm, "trained", told)
    assert lm.scored(docs).count() == 200
    every, rounds = seen[0]
    assert all(rounds) and sorted(sum(rounds, [])) == every


def test_texts_are_dealt_and_not_their_subwords(spark, monkeypatch):
    """What a round shuffles is its texts: ids are several times as large, and were more disk than the check allows."""
    docs = spark.createDataFrame([(i, f"word{i} and some other words") for i in range(50)], "doc_id long, text string")
    plans, trained = [], lm.trained

    def told(fitted, counts, rates, turn):
        plans.append(turn(0, 3, 4)._jdf.queryExecution().optimizedPlan().toString())
        return trained(fitted, counts, rates, turn)

    monkeypatch.setattr(lm, "trained", told)
    assert lm.scored(docs, rates=(0.01,)).count() == 50
    assert plans[0].index("MapInArrow") < plans[0].index("Repartition 4")  # a plan's first line is its last step


def test_steps_keep_their_memory():
    """A step's arrays are not mapped anew each time: that was a third of a fit's time."""
    code = """
import resource
import numpy as np
from cartoflow.llm import lm
r, net = np.random.default_rng(0), lm.Attention(5000)
ids = r.integers(0, 5000, 30_000)
net.learn_ids(np.bincount(ids, minlength=5000))
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
net.fit(ids[:6000], np.zeros(6000, int), 1, 0.01)
before = faults()
net.fit(ids, np.arange(30_000) // 3000, 1, 0.01)
print(faults() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) < 3000
