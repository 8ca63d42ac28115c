"""The keyed table against a dictionary of rows: rules, reruns, half-written batches, untouched buckets, bad keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cartoflow.operators.relational import upsert
from cartoflow.store.keyed import KeyedTable, append_batch

SCHEMA = "id long, k string, name string, category string, confidence double, tier string, since int, tags array<string>, at int"
CHOOSE = {"category": "fill", "confidence": "greatest", "tier": "with:confidence", "since": "keep"}


def rows_of(r, n, start=0):
    out = []
    for i in range(n):
        out.append((r.randrange(40), r.choice("ab"), f"n{r.randrange(99)}", r.choice([None, "x", "y"]), r.randrange(10) / 10, r.choice("pq"), r.randrange(50), [str(r.randrange(5))], start + i))
    return out


def applied(table, rows):
    """One row after the other, as a database would."""
    for x in rows:
        key = x[:2]
        old = table.get(key)
        if old is None:
            table[key] = x
        else:
            tier = x[5] if x[4] >= old[4] else old[5]
            table[key] = (*key, x[2], x[3] if x[3] is not None else old[3], max(x[4], old[4]), tier, old[6], x[7], x[8])
    return table


def test_upserts(spark, tmp_path):
    r = random.Random(0)
    path = f"file://{tmp_path}/t"
    table, want = KeyedTable(spark, path, ["id", "k"], CHOOSE, buckets=5), {}
    for batch in range(4):
        rows = rows_of(r, 120 if batch else 60, 1000 * batch)
        new = {x[:2] for x in rows} - want.keys()
        counts = table.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3), f"b{batch}", [F.col("at")])
        assert counts == {"inserted": len(new), "updated": len({x[:2] for x in rows}) - len(new)}
        want = applied(want, rows)
        assert sorted(map(tuple, table.read().collect())) == sorted(want.values())
        if batch % 2:  # run again
            assert table.upsert(spark.createDataFrame(rows, SCHEMA), f"b{batch}", [F.col("at")]) == {"inserted": 0, "updated": 0}
            assert sorted(map(tuple, table.read().collect())) == sorted(want.values())
    asked = spark.createDataFrame([(3, "a"), (99, "a")], "id long, k string")
    assert [tuple(x) for x in table.get(asked).collect()] == [want[3, "a"]]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    table.upsert(spark.range(200).withColumn("v", F.lit(1)), "1")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "t") for f in fs if f.endswith(".parquet")}
    before = files()
    assert len(before) == 8
    table.upsert(spark.createDataFrame([(7, 2)], "id long, v int"), "2")
    assert len(set(before) - set(files())) == 1 and len(files()) == 8
    assert table.read().where("v = 2").collect() == [(7, 2)] and table.read().count() == 200


def test_half_written_batch(spark, tmp_path):
    """A batch that has reached some buckets only: the second run finishes it and applies nothing twice."""
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], {"since": "keep"}, buckets=4)
    schema = "id long, since int, v string"
    table.upsert(spark.createDataFrame([(i, 1, "a") for i in range(40)], schema), "1")
    batch = spark.createDataFrame([(i, 2, "b") for i in range(20, 60)], schema)
    bucket = table.bucket()
    table.upsert(batch.where(bucket < 2), "2")
    counts = table.upsert(batch, "2")
    assert counts == {"inserted": batch.where((bucket >= 2) & (F.col("id") >= 40)).count(), "updated": batch.where((bucket >= 2) & (F.col("id") < 40)).count()}
    assert sorted(map(tuple, table.read().collect())) == [(i, 1 if i < 40 else 2, "a" if i < 20 else "b") for i in range(60)]


def test_bad_use(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, ["id"], buckets=4)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, 1)], "id long, v int"), "1")
    assert table.upsert(spark.createDataFrame([], "id long, v int"), "1") == {"inserted": 0, "updated": 0}
    with pytest.raises(ValueError):
        KeyedTable(spark, path, ["id"], buckets=5)


def test_rules_agree_with_the_frame_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.9)], "id long, category string, confidence double")
    new = spark.createDataFrame([(2, None, 0.1), (3, "c", 0.2), (1, None, 0.7)], "id long, category string, confidence double")
    choose = {"category": "fill", "confidence": "greatest"}
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], choose, 2)
    table.upsert(old, "1")
    table.upsert(new, "2")
    assert sorted(table.read().collect()) == sorted(upsert(old, new, ["id"], choose).collect())


def test_append_batch(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = spark.range(30).withColumn("r", F.rand())  # a second evaluation would not give the same rows
    assert append_batch(rows.where("r >= 0"), path, "1") == 30
    assert append_batch(spark.range(5).withColumn("r", F.lit(0.0)), path, "2") == 5
    assert append_batch(spark.range(7).withColumn("r", F.lit(0.0)), path, "2") == 7  # run again
    assert append_batch(spark.range(0).withColumn("r", F.lit(0.0)), path, "3") == 0
    assert spark.read.parquet(path).count() == 37
