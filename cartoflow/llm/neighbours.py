r"""Quality by votes of the nearest labelled documents, over latent-semantic vectors.

1. Terms.  A text is counted in HALF buckets of marks and HALF of grams, by hash.  Marks are runs of 2 to 4 symbols of its
   outline: letters, capitals and digits are one symbol each, equal symbols in a row are one, a word that repeats the word
   before it begins with a symbol of its own, and other bytes stand for themselves.  Grams are runs of 3 bytes.
2. Weights.  Square roots of counts times log(1 + documents / (1 + documents with the term)), over all documents; both
   halves have length 1 and GRAM_WEIGHT.
3. Latent space.  The leading directions of all documents' vectors: a subspace of DIMS directions, multiplied ROUNDS times by
   the corpus' term-term matrix (never formed: each task adds vectors times their coordinates) and made orthogonal.
4. Votes.  The labelled vectors are broadcast.  Every document's cosines with all of them are one product of two blocks; its
   NEAREST vote with their cosine to the power SHARPNESS (all that tie with the last vote too).  A class that the sample
   holds a part of has its votes scaled to the whole.

Bound: SAMPLE labelled documents a class (least hashes of their ids) are the labelled vectors, so the broadcast is of
2 * SAMPLE * DIMS numbers at most, and the space of TERMS * DIMS.  Term counts and directions are of all documents; sums meet
in tasks by ranges of terms, and the driver gets one sum.

Cases.  Null or empty text, or none in common with anything labelled: the share of label 1.  A document with several labels
is good if all say so; null labels count for nothing.  No labelled rows: every score is 1/2.  Labels of one class only: every
score is that class.  A doc_id with several texts is labelled by the least of them.  Repeated rows: a row each.  Empty table:
empty result.  Null doc_id: scored, held_out null.  A very long text is counted in slices.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import NOT_SPACE, Block, blocks, hashed_sample, only, small_batches, span_hashes

#: Labelled documents a class, at most.
SAMPLE = 4_000
HALF, DIMS, ROUNDS = 2048, 64, 2
TERMS = 2 * HALF
GRAM_WEIGHT = 0.6
NEAREST, SHARPNESS = 15, 8
#: Votes that the share of label 1 counts for.
LEAST_VOTE = 1e-6
#: Texts of a block, bytes that are hashed at once, and tasks that sums meet in.
ROWS, SLICE, RANGES = 256, 1 << 20, 16

_OUTLINE = np.arange(256, dtype=np.uint8)
_OUTLINE[0x61:0x7B] = _OUTLINE[0x80:] = ord("a")
_OUTLINE[0x41:0x5B], _OUTLINE[0x30:0x3A] = ord("A"), ord("0")
_REPEAT = 1
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def held_out_of(doc_id: Column, folds: int = 3) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 1


def _grams(codes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Counts by text and bucket of the runs of k symbols within texts of these sizes."""
    n, edges = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(n * HALF + 1, np.int64)
    for lo in range(0, len(codes) - k + 1, SLICE):
        window = codes[lo : lo + SLICE + k - 1].astype(np.uint32)
        m = len(window) - k + 1
        h = np.full(m, k * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for j, factor in enumerate(_FACTORS[:k]):
            h += window[j : j + m] * factor
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = (h >> np.uint32(32 - 11)).astype(np.int64)
        at += np.repeat(np.arange(0, n * HALF, HALF), np.diff(np.clip(edges, lo, lo + m)))
        across = (edges[1:-1, None] - np.arange(1, k)).ravel() - lo
        at[across[(across >= 0) & (across < m)]] = n * HALF
        out += np.bincount(at, minlength=n * HALF + 1)
    return out[:-1].reshape(n, HALF)


def counted(block: Block) -> np.ndarray:
    """Term counts, a row a text."""
    if not block.n:
        return np.zeros((0, TERMS), np.float32)
    outline = _OUTLINE[block.data]
    starts, ends, owners = block.words(block.data, NOT_SPACE)
    words = span_hashes(block.data, starts, ends)
    again = np.flatnonzero((words[1:] == words[:-1]) & (owners[1:] == owners[:-1])) + 1
    outline[starts[again]] = _REPEAT
    kept = np.ones(len(outline), bool)
    kept[1:] = (outline[1:] != outline[:-1]) | (outline[1:] == ord("\n"))
    sizes = np.add.reduceat(kept, block.starts, dtype=np.int64)
    marks = sum(_grams(outline[kept], sizes, k) for k in (2, 3, 4))
    return np.concatenate([marks, _grams(block.data, block.lengths + 1, 3)], 1).astype(np.float32)


def weighed(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.sqrt(counts) * weight
    for part, size in ((out[:, :HALF], 1.0), (out[:, HALF:], GRAM_WEIGHT)):
        part *= size / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    return blocks((batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)), "text")


def _summed(docs: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all blocks of arrays of TERMS rows; in the order of tasks, so that reruns agree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, width))
        for _, block in _blocks(batches):
            total += of_block(counted(block))
        if total.any():
            parts = np.split(total.astype(np.float32), RANGES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES)), pa.array(np.full(RANGES, TaskContext.get().partitionId())), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "task", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "sums"])

    rows = docs.mapInArrow(each, "part long, task long, sums binary").repartition(RANGES, "part").sortWithinPartitions("part", "task").mapInArrow(add, "part long, sums binary")
    out = np.zeros((RANGES, TERMS // RANGES, width))
    for part, raw in rows.collect():
        out[part] = np.frombuffer(raw).reshape(out.shape[1:])
    return out.reshape(TERMS, width)


class Model(NamedTuple):
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    votes: np.ndarray
    share: float

    def placed(self, block: Block) -> np.ndarray:
        """Unit vectors of the texts in the latent space; zero for those without terms."""
        z = weighed(counted(block), self.weight) @ self.basis
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)

    def score(self, block: Block) -> np.ndarray:
        if not len(self.label):
            return np.full(block.n, self.share)
        cosine = np.maximum(self.placed(block) @ self.vectors.T, 0)
        k = min(NEAREST, len(self.label))
        last = np.partition(cosine, len(self.label) - k, 1)[:, len(self.label) - k, None]
        votes = np.where(cosine >= np.maximum(last, 1e-6), cosine, 0).astype(np.float64) ** SHARPNESS * self.votes
        return np.clip((votes @ self.label + LEAST_VOTE * self.share) / (votes.sum(1) + LEAST_VOTE), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    source = only(docs, doc_id="doc_id", text="text")
    texts = source.select("text")
    n = texts.count()
    even, basis = np.ones(TERMS, np.float32), np.linalg.qr(np.random.default_rng(0).standard_normal((TERMS, DIMS)))[0].astype(np.float32)

    def begun(counts: np.ndarray) -> np.ndarray:
        x = weighed(counts, even)
        return np.concatenate([(counts > 0).sum(0, dtype=np.float64)[:, None], x.T @ (x @ basis)], 1)

    first = _summed(texts, begun, DIMS + 1)
    weight = np.log1p(n / (1 + first[:, 0])).astype(np.float32)
    basis = np.linalg.qr(first[:, 1:])[0].astype(np.float32)
    for _ in range(ROUNDS - 1):
        shared = spark.sparkContext.broadcast((weight, basis))

        def multiplied(counts: np.ndarray, shared=shared) -> np.ndarray:
            x = weighed(counts, shared.value[0])
            return x.T @ (x @ shared.value[1])

        basis = np.linalg.qr(_summed(texts, multiplied, DIMS))[0].astype(np.float32)

    told = only(labels, doc_id="doc_id", label="quality").where("label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    told = told.where(~held_out_of(F.col("doc_id"), folds))
    totals = {int(r[0]): r[1] for r in told.groupBy("label").count().collect()}
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    model = Model(weight, basis, np.zeros((0, DIMS), np.float32), np.zeros(0), np.zeros(0), share)
    if not totals:
        return model
    shared = spark.sparkContext.broadcast(model)
    chosen = None
    for label, total in sorted(totals.items()):
        part = hashed_sample(told.where(F.col("label") == label), ["doc_id"], sample, total)
        chosen = part if chosen is None else chosen.union(part)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array([x.tobytes() for x in shared.value.placed(block)], pa.binary())], names=["doc_id", "label", "vector"])

    # At most 2 * sample rows are broadcast, and as many vectors come back.
    mine = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = mine.mapInArrow(placed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label {mine.schema['label'].dataType.simpleString()}, vector binary").orderBy("doc_id").toArrow()
    vectors = np.frombuffer(b"".join(found["vector"].to_pylist()), np.float32).reshape(-1, DIMS)
    label = found["label"].to_numpy().astype(int)
    scale = {x: totals[x] / max(1, (label == x).sum()) for x in totals}
    return model._replace(vectors=vectors, label=label.astype(float), votes=np.array([scale[x] for x in label.tolist()]))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, sample))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in _blocks(batches):
            score = model.value.score(block)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = only(docs, doc_id="doc_id", text="text").withColumn("held_out", held_out_of(F.col("doc_id"), folds))
    return source.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
