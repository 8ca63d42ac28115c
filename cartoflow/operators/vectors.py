"""Nearest vectors by cosine: an inverted file over all rows, searched in part or exactly.

``build`` fits coarse centroids on a bounded sample (SAMPLE_BYTES of the vectors with the least hashes of their ids) and
gives every row of the table to its nearest one.  Rows of a cell lie in packs of PACK vectors, a row of the shared folder
each; a cell with many rows is dealt to several tasks, so no cell meets in one.  A pack knows how far its members are from
the centroid.

``search`` looks into the PROBES nearest cells of each query; how many a recall needs depends on the vectors, and
``probes_for`` measures it on some queries.  ``exact`` does that first and then looks into every cell that
can still hold something nearer: by the triangle inequality on angles nothing in a cell is nearer to a query than its
centroid less the cell's radius.  Both compare whole vectors (there is nothing to re-rank), a block of queries with a pack at
a time, and keep k a pack before results meet.  ``recall`` says what share of the exact answers a search has found.

Order is by similarity rounded to six digits, then id.  Null vectors are in no cell and ask for nothing; zero vectors have
similarity 0.  All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.store.shared import spool

SAMPLE_BYTES, CELLS, ROUNDS = 64 << 20, 4096, 8
#: Vectors of a pack, queries of a block, rows of a cell that one task packs.
PACK, ASKED, DEALT = 2048, 512, 200_000
PROBES = 8


class Index(NamedTuple):
    """Centroids, the least cosine of a cell's members with its centroid, the packs (cell, ids, vectors), and (id, cell)."""

    centroids: np.ndarray
    least: np.ndarray
    packs: DataFrame
    cells: DataFrame


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)


def centroids_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of spherical k-means; cells that run empty take the members that are farthest from their own.

    The sample is held once, as it is; what is computed of it is a block's at a time.
    """
    blocks = np.array_split(np.arange(len(sample)), len(sample) // 512 + 1)
    found = unit(sample[np.linspace(0, len(sample) - 1, cells).astype(int)])
    near, like = np.zeros(len(sample), np.int32), np.zeros(len(sample))
    for _ in range(rounds):
        sums = np.zeros_like(found)
        for at in blocks:
            points = unit(sample[at])
            cosines = points @ found.T
            near[at], like[at] = cosines.argmax(1), cosines.max(1)
            np.add.at(sums, near[at], points)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        if len(empty):
            sums[empty] = unit(sample[like.argsort(kind="stable")[: len(empty)]])
        found = unit(sums)
    return found


def build(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", cells: int | None = None) -> Index:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return Index(np.zeros((0, 0)), np.zeros(0), spool(spark.createDataFrame([], "cell int, low double, ids array<long>, vectors binary")), spark.createDataFrame([], "id long, cell int"))
    most = max(1, SAMPLE_BYTES // (4 * size))
    h = F.xxhash64("id")
    share = rows if n <= most else rows.where(F.pmod(h, F.lit(1 << 20)) < max(1, int(1.2 * most / n * (1 << 20))))
    sample = share.orderBy(h, "id").limit(most).select("v").toArrow()["v"].combine_chunks()
    centroids = centroids_of(_matrix(sample, len(sample)), cells or max(1, min(CELLS, round(n**0.5), len(sample))))
    shared = spark.sparkContext.broadcast(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unit(_matrix(batch.column("v"), batch.num_rows)) @ shared.value.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1).astype(np.int32)), pa.array(near.max(1))], names=["id", "v", "cell", "near"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cell, count = -1, 0

        def out() -> pa.RecordBatch:
            ids, v, near = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([float(near.min())]), pa.array([ids], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], names=["cell", "low", "ids", "vectors"])

        for batch in batches:
            of = batch.column("cell").to_numpy()
            ids, near, v = batch.column("id").to_numpy(), batch.column("near").to_numpy(), _matrix(batch.column("v"), batch.num_rows) if batch.num_rows else None
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                while lo < hi:
                    if held and (of[lo] != cell or count >= PACK):
                        yield out()
                        held, count = [], 0
                    cell, step = int(of[lo]), min(hi, lo + PACK - count)
                    held.append((ids[lo:step], v[lo:step], near[lo:step]))
                    count, lo = count + step - lo, step
        if held:
            yield out()

    located = spool(rows.mapInArrow(placed, "id long, v array<float>, cell int, near double"))
    deal = located.groupBy("cell").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("deal"))  # a row a cell
    dealt = located.join(F.broadcast(deal), "cell").select("id", "v", "cell", "near", F.pmod(F.xxhash64("id"), F.col("deal")).alias("hand"))
    packs = dealt.repartition("cell", "hand").sortWithinPartitions("cell", "id").select("id", "v", "cell", "near").mapInArrow(packed, "cell int, low double, ids array<long>, vectors binary")
    packs = spool(packs)
    least = np.ones(len(centroids))
    for cell, low in packs.groupBy("cell").agg(F.min("low")).collect():
        least[cell] = low
    return Index(centroids, least, packs, located.select("id", "cell"))


def _asking(queries: DataFrame, id_: str, embedding: str) -> DataFrame:
    return queries.select(F.col(id_).cast("long").alias("query_id"), F.col(embedding).cast("array<float>").alias("v")).where("query_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").dropDuplicates(["query_id"])


def _asked_cells(asking: DataFrame, which: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows (cell, query_id, v): the cells (a boolean matrix) that each query looks into."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                row, cell = np.nonzero(which(unit(_matrix(part.column("v"), part.num_rows)), part))
                rows = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), rows.column("query_id"), rows.column("v")], names=["cell", "query_id", "v"])

    return asking.mapInArrow(each, "cell int, query_id long, v array<float>")


def _compared(asked: DataFrame, packs: DataFrame, k: int, least: float) -> DataFrame:
    """Rows (query_id, vec_id, similarity): the best k of each pack for each query that looks into its cell."""

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("cell").to_numpy()
            edges = sorted({0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), *range(0, len(of), ASKED), len(of)})
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([int(of[lo])], pa.int32()), pa.array([part.column("query_id").to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(part.column("v"), hi - lo).tobytes()], pa.binary())], names=["cell", "queries", "asked"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                queries, ids = (np.asarray(batch.column(c)[row].values) for c in ("queries", "ids"))
                a, b = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float32).reshape(len(x), -1) for c, x in (("asked", queries), ("vectors", ids)))
                found = np.round(unit(a) @ unit(b).T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(ids, found.shape), -found))[:, :k]
                best = np.take_along_axis(found, order, 1)
                q, j = np.nonzero(best >= least)
                yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(ids[order[q, j]]), pa.array(best[q, j])], names=["query_id", "vec_id", "similarity"])

    blocks = asked.repartition("cell").sortWithinPartitions("cell", "query_id").mapInArrow(blocked, "cell int, queries array<long>, asked binary")
    return blocks.join(packs.select("cell", "ids", "vectors"), "cell").select("queries", "asked", "ids", "vectors").mapInArrow(products, "query_id long, vec_id long, similarity double")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("position", F.row_number().over(by)).where(F.col("position") <= k).select("query_id", "vec_id", "similarity", "position")


def _nearest(cosines: np.ndarray, probes: int) -> np.ndarray:
    out = np.zeros(cosines.shape, bool)
    np.put_along_axis(out, np.argsort(-cosines, 1, kind="stable")[:, :probes], True, 1)
    return out


def search(queries: DataFrame, index: Index, k: int, least: float = -1.0, probes: int = PROBES, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, vec_id, similarity, position): the best k of the cells that are nearest to each query."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    asked = _asked_cells(_asking(queries, id_, embedding), lambda v, part: _nearest(v @ shared.value.T, probes) if len(shared.value) else np.zeros((len(v), 0), bool))
    return _best(_compared(asked, index.packs, k, least), k)


def exact(queries: DataFrame, index: Index, k: int, least: float = -1.0, probes: int = PROBES, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The same of all cells: what a search has found says which other cells need a look."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, np.arccos(np.clip(index.least, -1, 1))))
    asking = _asking(queries, id_, embedding)
    first = spool(search(queries, index, k, least, probes, id_, embedding))
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("floor"))
    held = asking.join(floor, "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(least)).alias("floor"))

    def others(v: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        centroids, radius = shared.value
        if not len(centroids):
            return np.zeros((len(v), 0), bool)
        cosines = v @ centroids.T
        bound = np.cos(np.maximum(0, np.arccos(np.clip(cosines, -1, 1)) - radius))
        # Rounded similarities that tie with the floor may still come first by id; a zero vector lies at 0 wherever it is.
        return (np.maximum(bound, 0) >= part.column("floor").to_numpy()[:, None] - 2e-6) & ~_nearest(cosines, probes)

    more = _compared(_asked_cells(held, others), index.packs, k, least)
    return _best(first.select("query_id", "vec_id", "similarity").unionByName(more), k)


def probes_for(queries: DataFrame, index: Index, k: int, target: float = 0.95, sample: int = 64, id_: str = "vec_id", embedding: str = "embedding") -> int:
    """The fewest probes that find ``target`` of the exact answers of ``sample`` queries (those of least hash)."""
    asked = spool(_asking(queries, id_, embedding).orderBy(F.xxhash64("query_id")).limit(sample))
    answers = exact(asked, index, k, id_="query_id", embedding="v")
    rows = answers.join(index.cells.withColumnRenamed("id", "vec_id"), "vec_id").join(F.broadcast(asked), "query_id").select("v", "cell").toArrow()  # sample * k rows
    if not rows.num_rows:
        return PROBES
    cosines = unit(_matrix(rows["v"].combine_chunks(), rows.num_rows)) @ index.centroids.T
    cell = rows["cell"].to_numpy()
    before = (cosines > np.take_along_axis(cosines, cell[:, None], 1)).sum(1)
    return int(np.sort(before)[int(np.ceil(target * len(before))) - 1]) + 1


def recall(found: DataFrame, exact_rows: DataFrame) -> DataFrame:
    """Rows (query_id, wanted, found, recall): what of the exact answers a search has; equal similarities count as equal."""
    last = exact_rows.groupBy("query_id").agg(F.count("*").alias("wanted"), F.min("similarity").alias("last"))
    mine = found.join(last, "query_id").where(F.col("similarity") >= F.col("last")).groupBy("query_id").agg(F.count("*").alias("found"))
    out = last.join(mine, "query_id", "left").select("query_id", "wanted", F.coalesce("found", F.lit(0)).alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("wanted"))
