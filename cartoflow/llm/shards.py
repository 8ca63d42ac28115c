"""Documents spooled in shards: what is learnt of a shard goes out as rows, and what others know of it comes back.

A shard is a run of documents of some MB, fixed when the documents are written to the shared folder; its files have one
row group each, so a shard is read by one task, whole and in the same order, however often.  The last row of a shard
carries a summary.  Rows (shard, ...) that belong to shards are written by part of the spool (``write_side``), and the
task that reads a part reads its rows too (``with_side``): texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import Block, blocks, shared_dir, small_batches, spool

SHARD, PLACE, SUMMARY = "__shard", "__place", "__summary"
PART_SHIFT = 20


def spool_shards(docs: DataFrame, summary: pa.StructType, ddl: str, add: Callable[[list, pa.RecordBatch, Block], None], close: Callable[[list], pa.StructArray], limit: int) -> DataFrame:
    """Write the documents (with a column ``text``) with __shard, __place and, on a shard's last row, __summary.

    ``add`` puts what it finds in a block into a list, ``close`` makes the summary of that list.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size, place, state = TaskContext.get().partitionId() << PART_SHIFT, None, 0, 0, []

        def out(rows: pa.RecordBatch, first: int, last: bool) -> pa.RecordBatch:
            found = close(state) if last else pa.array([], summary)
            offsets = pa.array([None] * (rows.num_rows - 1) + [0, len(found)] if last else [None] * rows.num_rows + [0], pa.int32())
            columns = [*rows.columns, pa.array(np.full(rows.num_rows, shard)), pa.array(np.arange(first, first + rows.num_rows)), pa.ListArray.from_arrays(offsets, found)]
            return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, SHARD, PLACE, SUMMARY])

        for rows, block in blocks(batches, "text"):
            if held is not None:
                full = size >= limit
                yield out(*held, full)
                if full:
                    shard, size, place = shard + 1, 0, 0
                    state.clear()
            add(state, rows, block)
            held, place, size = (rows, place), place + rows.num_rows, size + len(block.data)
        if held is not None:
            yield out(*held, True)

    small_batches(docs.sparkSession)
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {SHARD} long, {PLACE} long, {SUMMARY} array<{ddl}>"
    out = docs.mapInArrow(each, schema)
    out.write.option("parquet.block.size", 1 << 30).option("compression", "zstd").parquet(folder)  # a file has one row group: shards stay whole
    return spark.read.schema(out.schema).parquet(folder)


def spool_rows(docs: DataFrame) -> DataFrame:
    """Write the documents with __shard and __place, without a look at them: rows can be told by address what becomes of
    them, and no text is shuffled."""
    return spool(docs.withColumns({SHARD: F.shiftleft(F.spark_partition_id().cast("long"), PART_SHIFT), PLACE: F.monotonically_increasing_id()}))


def at_places(base: DataFrame, chosen: DataFrame, **told: str) -> DataFrame:
    """The rows of ``base`` whose address (__shard, __place) is in ``chosen``, each with its long columns ``told`` of there."""
    folder = write_side(chosen.select(SHARD, PLACE, *told))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, side = None, {}
        for batch in batches:
            of = batch.column(batch.schema.get_field_index(SHARD)).to_numpy() >> PART_SHIFT
            place = batch.column(batch.schema.get_field_index(PLACE)).to_numpy()
            for here in np.unique(of).tolist():
                if part != here:
                    part, side = here, side_of_part(folder, here)
                    if side:
                        order = np.argsort(side[PLACE])
                        side = {c: x[order] for c, x in side.items()}
                if side:
                    at = np.minimum(np.searchsorted(side[PLACE], place), len(side[PLACE]) - 1)
                    rows = np.flatnonzero((side[PLACE][at] == place) & (of == here))
                    if len(rows):
                        out = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*out.columns, *[pa.array(side[c][at[rows]]) for c in told]], names=[*out.schema.names, *told])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + "".join(f", {c} {kind}" for c, kind in told.items())
    return base.mapInArrow(each, schema)


def summaries(base: DataFrame) -> DataFrame:
    return base.where(F.col(SUMMARY).isNotNull()).select(SHARD, F.inline(SUMMARY))


def write_side(df: DataFrame, tasks: int | None = None) -> str:
    """Write rows (__shard, ...) by part to the shared folder; ``tasks`` where small ones should not be put together."""
    folder = shared_dir(df.sparkSession)
    df = df.withColumn("part", F.shiftright(F.col(SHARD), PART_SHIFT))
    (df.repartition("part") if tasks is None else df.repartition(tasks, "part")).write.partitionBy("part").parquet(folder)
    return folder


def side_of_part(folder: str, part: int) -> dict[str, np.ndarray]:
    """The rows of one part of the spool, by column; empty where it has none."""
    store, path = fs.FileSystem.from_uri(f"{folder}/part={part}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    files = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]
    table = pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read() for x in files])
    return {c: table.column(c).to_numpy() for c in table.column_names}


def with_side(batches: Iterator[pa.RecordBatch], folder: str, key: str) -> Iterator[tuple[int, list[pa.RecordBatch], dict[str, np.ndarray]]]:
    """Each shard's rows, with its rows of the side table sorted by ``key``."""
    part, side, shard, rows = None, {}, None, []

    def mine(shard: int) -> dict[str, np.ndarray]:
        nonlocal part, side
        if part != shard >> PART_SHIFT:
            side = {}
            part, side = shard >> PART_SHIFT, side_of_part(folder, shard >> PART_SHIFT)
            if side:
                order = np.lexsort((side[key], side[SHARD]))
                side = {c: x[order] for c, x in side.items()}
        if not side:
            return {}
        lo, hi = np.searchsorted(side[SHARD], [shard, shard + 1])
        return {c: x[lo:hi] for c, x in side.items()}

    for batch in batches:
        of = batch.column(batch.schema.get_field_index(SHARD)).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if shard is not None and int(of[lo]) != shard:
                yield shard, rows, mine(shard)
                rows = []
            shard = int(of[lo])
            rows.append(batch.slice(lo, hi - lo))
    if shard is not None:
        yield shard, rows, mine(shard)
