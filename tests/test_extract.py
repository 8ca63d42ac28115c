"""The places data source against Spark's own reader: row groups and folders skipped, nested columns, the ring, bad paths."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

from cartoflow.sources import extract
from cartoflow.sources.places import scan_places


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('extract')}/release=2024"
    k = F.col("id")
    x, y = 70 + k / 1000.0, 10 + k % 100 / 10.0
    rows = spark.range(20_000).select(k.cast("string").alias("id"), F.struct(F.concat(F.lit("n"), k).alias("primary"), F.lit("x" * 50).alias("other")).alias("names"), F.struct(F.lit("gym").alias("primary"), F.array(F.lit("a")).alias("hierarchy")).alias("taxonomy"), F.array(F.struct(F.lit("d").alias("dataset"), F.lit("l").alias("license"))).alias("sources"), F.struct(x.alias("xmin"), (x + 0.001).alias("xmax"), y.alias("ymin"), (y + 0.001).alias("ymax")).alias("bbox"), F.when(k % 7 == 0, "permanently_closed").when(k % 7 == 1, "open").alias("operating_status"), F.when(k % 3 == 0, "places").otherwise("other").alias("theme"))
    rows.repartitionByRange(4, F.col("bbox.xmin")).sortWithinPartitions("bbox.xmin").write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 8 << 10).partitionBy("theme").parquet(path)
    return path


BOX = (74.0, 12.0, 74.5, 15.0)


def test_scan(spark, folder):
    got = extract.scan_extract(spark, folder, BOX).where("theme = 'places'")
    want = scan_places(spark, folder, BOX).where("theme = 'places'")
    assert sorted(got.select("id", "names.primary", "theme", "bbox.xmin").collect()) == sorted(want.select("id", "names.primary", "theme", "bbox.xmin").collect())
    assert got.count() > 10
    few = extract.scan_extract(spark, folder, BOX, "id,names.primary,bbox,operating_status")
    assert few.schema["names"].dataType.names == ["primary"] and few.where("theme = 'places'").count() == got.count()


def test_row_groups_are_skipped(folder):
    box = [LessThanOrEqual(("bbox", "xmin"), BOX[2]), GreaterThanOrEqual(("bbox", "xmax"), BOX[0])]
    files = extract.files_of(folder)
    metas = [pq.ParquetFile(f.uri.removeprefix("file://")).metadata for f in files]
    kept, every = sum(len(extract.row_groups(m, box)) for m in metas), sum(m.num_row_groups for m in metas)
    assert every >= 8 and 0 < kept <= every / 3
    assert all(extract.row_groups(m, []) == list(range(m.num_row_groups)) for m in metas)
    reader = extract.Reader(folder, None, None)
    list(reader.pushFilters([EqualTo(("theme",), "places")]))
    assert {dict(f.folders)["theme"] for f in reader.partitions()} == {"places"} and {dict(f.folders)["theme"] for f in files} == {"places", "other"}


def test_own_reader_pushes_the_box(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = scan_places(spark, folder, BOX).where("theme = 'places'").select("names.primary")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(bbox.xmin" in plan and "PartitionFilters: [isnotnull(theme" in plan and "names:struct<primary:string>" in plan.split("ReadSchema")[1]


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="no Parquet files|Cannot get information|DATA_SOURCE|No such file|not found"):
        (tmp_path / "none").mkdir()
        extract.scan_extract(spark, f"file://{tmp_path}/none", BOX).count()
