r"""Benchmark contamination by winnowing.

Texts are lower-cased (A-Z) and cut to words.  Of every window of WINDOW consecutive K-word hashes the smallest is a
fingerprint, so two texts that share SPAN = K + WINDOW - 1 words share a fingerprint inside them.  Benchmark
fingerprints set bits of a table of fixed size; documents keep those of theirs whose bit is set, join them with the
benchmark's, and extend each hit to the SPAN-word windows around it, compared word by word.  An item of fewer than
SPAN words is one window; those lengths are looked up directly.

Cases.  Null or empty text: no words.  An item without words matches nothing.  Repeated item_id: one item with the
windows of all its rows; a null item_id is the id of an empty string.  Repeated or null doc_id: each row is judged by
itself.  Empty tables: no rows, or no hits.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import ALNUM, Block, blocks, gram_hashes, mixed, only, set_aside, sliding, small_batches, span_hashes, spool

SPAN, K = 13, 7
WINDOW = SPAN - K + 1
#: Bits of the table of benchmark fingerprints: 2 MB, whatever the benchmark's size.
TABLE_BITS = 24

_HIT = pa.struct([("h", pa.int64()), ("start", pa.int64()), ("words", pa.string()), ("size", pa.int32())])
_HITS = "array<struct<h:long,start:long,words:string,size:int>>"


def _kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of windows of different lengths do not meet: 0 for the K-word grams, else the item's length."""
    return mixed(hashes + np.uint64(kind + 1))


def _winnowed(words: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: K-word grams that are least in some window within one text."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _kind(gram_hashes(words, K), 0)
    least = np.where(owners[:n] == owners[SPAN - 1 :], sliding(grams, WINDOW), np.uint64(0))
    pad = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == grams)
    return at, grams[at]


def _set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _found(block: Block, sizes: list[int], table: np.ndarray | None) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each text, and its hits (fingerprint, first word, words around it, length of a window).

    Without a table (the benchmark): all fingerprints, and short texts as one window.  With one: those it may have.
    """
    data = block.lower()
    starts, ends, owners = block.words(data, ALNUM)
    counts = block.per_text(owners)
    hits: list[list[tuple]] = [[] for _ in range(block.n)]
    if not len(starts):
        return counts, hits
    words, first = span_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(counts)])
    text = lambda a, b: " ".join(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in range(a, b))
    at, hashes = _winnowed(words, owners)
    if table is not None and len(at):
        keep = _set(table, hashes)
        at, hashes = at[keep], hashes[keep]
    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
        doc = int(owners[i])
        a, b = max(int(first[doc]), i - SPAN + K), min(int(first[doc + 1]), i + SPAN)
        hits[doc].append((h, a - int(first[doc]), text(a, b), SPAN))
    for size in sizes:
        n = len(words) - size + 1
        if n <= 0:
            continue
        grams = _kind(gram_hashes(words, size), size)
        fits = owners[:n] == owners[size - 1 :]
        at = np.flatnonzero(fits & (counts[owners[:n]] == size) if table is None else fits & _set(table, grams))
        for i, h in zip(at.tolist(), grams[at].view(np.int64).tolist(), strict=True):
            doc = int(owners[i])
            hits[doc].append((h, i - int(first[doc]), text(i, i + size), size))
    return counts, hits


def _windows(hits: DataFrame) -> DataFrame:
    """Each hit's words as its windows of ``size`` words; ``start`` moves along."""
    parts = F.split("words", " ")
    first = F.sequence(F.lit(0), F.size("_w") - F.col("size"))
    return hits.withColumn("_w", parts).where(F.size("_w") >= F.col("size")).withColumn("_i", F.explode(first)).withColumns({"start": F.col("start") + F.col("_i"), "window": F.array_join(F.slice("_w", F.col("_i") + 1, F.col("size")), " ")}).drop("_w", "_i", "words")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash (xxhash64), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(sizes: list[int], table) -> "callable":
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None if table is None else table.value
            for rows, block in blocks(batches, "text"):
                counts, hits = _found(block, sizes, bits)
                kept = rows.drop_columns(["text"])
                hits = pa.array([[dict(zip(("h", "start", "words", "size"), x, strict=True)) for x in row] for row in hits], pa.list_(_HIT))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(counts), hits], names=[*kept.schema.names, "n_words", "hits"])

        return each

    items = only(benchmark, item_id="item_id", text="text").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    items = spool(items.mapInArrow(run(list(range(1, SPAN)), None), f"item_id string, n_words long, hits {_HITS}"))
    sizes = sorted(r[0] for r in items.where(f"n_words between 1 and {SPAN - 1}").select("n_words").distinct().collect())  # 12 at most
    item_hits = items.select("item_id", F.inline("hits"))
    bit = F.col("h").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    rows = item_hits.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << TABLE_BITS) - 1}) & 63 as int))")).alias("bits")).toPandas()  # at most 2**18 rows
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)

    source = only(docs, doc_id="doc_id", text="text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = spool(source.mapInArrow(run(sizes, spark.sparkContext.broadcast(table)), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_words long, hits {_HITS}"))

    # Fingerprints meet, then the windows around them, as words.
    hits = found.where(F.size("hits") > 0).select("row", F.inline("hits"))
    hits = _windows(hits.join(item_hits.select("h").distinct(), "h", "left_semi")).select("row", "start", "size", "window").distinct()
    windows = _windows(item_hits).select("item_id", "window").distinct()
    # Windows in the same set of items are one class, so a shared passage meets each of its items once a document.
    classes = windows.groupBy("window").agg(F.sum(F.xxhash64("item_id").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "item_id").cast("decimal(20,0)")).alias("s2"), F.count("*").alias("n"))
    classes = classes.withColumn("class", F.sha1(F.concat_ws("|", "s1", "s2", "n"))).select("window", "class")
    members = windows.join(classes.groupBy("class").agg(F.min("window").alias("window")), "window").select("class", "item_id")
    matched = spool(hits.join(classes, "window").select("row", "start", (F.col("start") + F.col("size")).alias("end"), "class"))

    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = matched.select("row", "start", "end").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    of = matched.select("row", "class").distinct().join(members, "class").select("row", "item_id").distinct()
    of = of.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    out = found.drop("hits").join(n_hit.join(of, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    bad = spool(contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    docs, named = set_aside(docs, "doc_id", "text")
    return named(docs.withColumn("_h", F.xxhash64("text")).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_anti").drop("_h"))
