"""The lifecycle stream against a plain replay, in one batch and in many; timers, ends, restarts, the listener."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cartoflow.streaming import events as E
from cartoflow.streaming import lifecycle as L

SCHEMA = "run long, id long, kind string, stage string, ts timestamp"
IDLE, MOST = 60_000, 2


def replay(rows, watermark):
    """Event by event, with all silences as they are at the watermark."""
    out = {}
    runs = {}
    for run, id_, kind, stage, at in rows:
        runs.setdefault(run, []).append((at, id_, kind, stage))
    for run, events in runs.items():
        seq, last, open_, done = 0, None, {}, []
        for at, _, kind, stage in [*sorted(events), (watermark, None, None, None)]:
            if last is not None and at > last:
                due = (at - last) // IDLE
                for k in range(1, min(due, MOST) + 1):
                    seq += 1
                    done.append((seq, "heartbeat", None, last + k * IDLE, None))
                if due > MOST:
                    done.append((seq + 1, "done", None, last + (MOST + 1) * IDLE, None))
                    seq, open_ = 0, {}
            if kind is None:
                break
            elapsed = None
            if kind == "started":
                open_[stage] = at
            elif stage in open_:
                elapsed = at - open_.pop(stage)
            seq += 1
            done.append((seq, kind, stage, at, elapsed))
            last = at
        out[run] = done
    return out


def events_of(seed, n=120):
    r = random.Random(seed)
    at, rows = 1_700_000_000_000, []
    for i in range(n):
        at += r.choice([1000, 20_000, 20_000, 70_000, 400_000])
        rows.append((r.randrange(5), i, r.choice(["started", "finished", "failed"]), r.choice(["geo", "crawl"]), at))
    return rows


def run_stream(spark, tmp_path, rows, parts):
    folder = tmp_path / "in"
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in rows[k * size : (k + 1) * size]], "run long, id long, kind string, stage string, at long")
        part.select("run", "id", "kind", "stage", F.timestamp_millis("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        time.sleep(0.05)  # files are read in the order of their times
    listener = L.Progress()
    spark.streams.addListener(listener)
    try:
        with L.state_in_rocksdb(spark):
            query = E.publish(L.lifecycle(E.source(spark, f"file://{folder}", "*.parquet", SCHEMA, 1), "run", IDLE, MOST, "1 second"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
            query.awaitTermination()
        for _ in range(100):
            if str(query.id) in listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows[str(query.id)] == len(rows) and listener.ended[str(query.id)] is None and listener.batches[str(query.id)] >= parts
    out = {}
    for r in spark.read.parquet(f"file://{tmp_path}/out").collect():
        out.setdefault(r["run"], []).append((r["at"], r["seq"], r["kind"], r["stage"], r["elapsed_ms"]))
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_lifecycle(spark, tmp_path, parts):
    rows = events_of(parts)
    got = run_stream(spark, tmp_path, rows, parts)
    want = replay(rows, max(r[4] for r in rows) - 1000)
    assert got.keys() == want.keys()
    for run, events in want.items():
        assert sorted(got[run]) == sorted((at, seq, kind, stage, elapsed) for seq, kind, stage, at, elapsed in events), run
    kinds = {k for v in want.values() for _, k, *_ in v}
    assert {"heartbeat", "done", "started"} <= kinds
