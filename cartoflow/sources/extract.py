"""The places extract as a data source of its own: ``spark.read.format("places_extract")``.

Filters of a query are pushed to the reader, on nested columns too: those on folder names (``theme=places``) choose files where
they are listed, the others choose row groups by the statistics of each file's footer, which the task that reads the file
looks at (the driver lists files and opens one, for the schema).  Spark applies all filters again, so statistics only ever
save work.  ``columns`` names the fields to read (``bbox,names.primary``): leaves that are not named are not read.

Needs ``spark.sql.python.filterPushdown.enabled``, which ``scan_extract`` sets.  Any store that Arrow opens by URI will do; for
others there is ``scan_places``, over Spark's own reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Whether rows between least and greatest can hold what is asked.
_RANGES = {EqualTo: lambda lo, hi, v: lo <= v <= hi, LessThan: lambda lo, hi, v: lo < v, LessThanOrEqual: lambda lo, hi, v: lo <= v, GreaterThan: lambda lo, hi, v: hi > v, GreaterThanOrEqual: lambda lo, hi, v: hi >= v}
_ROWS = 10_000


@dataclass
class File(InputPartition):
    uri: str
    folders: tuple[tuple[str, str], ...]


def may_hold(found: Filter, lo, hi) -> bool:
    """Whether a range of values can pass a filter; what cannot be told may."""
    test = _RANGES.get(type(found))
    try:
        return test is None or lo is None or hi is None or test(lo, hi, found.value)
    except TypeError:
        return True


def row_groups(meta: pq.FileMetaData, filters: Sequence[Filter]) -> list[int]:
    """The row groups whose statistics let every filter pass."""
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        stats = [(f, group.column(at[path]).statistics) for f in filters if (path := ".".join(f.attribute)) in at] if filters else []
        if all(s is None or not s.has_min_max or may_hold(f, s.min, s.max) for f, s in stats):
            out.append(g)
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, columns: list[str] | None):
        self.path, self.schema, self.columns, self.filters = path, schema, columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = [f for f in filters if type(f) in _RANGES]
        yield from filters  # Spark applies them all: ranges are not rows

    def partitions(self) -> list[File]:
        wanted = [f for f in self.filters if len(f.attribute) == 1]
        return [f for f in files_of(self.path) if all(may_hold(w, v, v) for w in wanted for k, v in f.folders if k == w.attribute[0])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.uri)
        with store.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            groups = row_groups(file.metadata, self.filters)
            if not groups:
                return
            names = [f.name for f in self.schema if f.name not in dict(partition.folders)]
            for batch in file.iter_batches(_ROWS, row_groups=groups, columns=self.columns or names):
                own = dict(zip(batch.schema.names, batch.columns, strict=True)) | {k: pa.array([v] * batch.num_rows) for k, v in partition.folders}
                yield pa.RecordBatch.from_arrays([own[f.name] for f in self.schema], names=self.schema.names)


def files_of(path: str) -> list[File]:
    """Parquet files under a folder, with their hive folders."""
    store, root = fs.FileSystem.from_uri(path)
    head = path[: len(path) - len(root)] if path.endswith(root) else "file://"
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/")))
    return [File(f"{head}{n}", tuple(tuple(p.split("=", 1)) for p in n[len(root) :].split("/")[:-1] if "=" in p)) for n in names]


class PlacesExtract(DataSource):
    @classmethod
    def name(cls) -> str:
        return "places_extract"

    def _columns(self) -> list[str] | None:
        return [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else None

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no Parquet files under {self.options['path']}")
        store, path = fs.FileSystem.from_uri(files[0].uri)
        with store.open_input_file(path) as source:
            columns = self._columns()
            file = pq.ParquetFile(source)
            kept = file.schema_arrow if columns is None else next(file.iter_batches(1, row_groups=[], columns=columns), None)
            kept = kept if isinstance(kept, pa.Schema) else pa.Table.from_batches([], schema=file.read_row_groups([], columns=columns).schema).schema
        for k, _ in files[0].folders:
            kept = kept.append(pa.field(k, pa.string()))
        return from_arrow_schema(kept.remove_metadata())

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, self._columns())


def scan_extract(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], columns: str | None = None) -> DataFrame:
    """Open places of an extract within a box, by this source."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PlacesExtract)
    read = spark.read.format("places_extract").option("path", path)
    rows = (read if columns is None else read.option("columns", columns)).load()
    x1, y1, x2, y2 = bbox
    rows = rows.where((F.col("bbox.xmin") <= x2) & (F.col("bbox.xmax") >= x1) & (F.col("bbox.ymin") <= y2) & (F.col("bbox.ymax") >= y1))
    return rows.where("operating_status IS NULL OR operating_status <> 'permanently_closed'") if "operating_status" in rows.columns else rows
