r"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Fingerprints: XXH64 (seed 42) of the 3-word shingles, repeats included; a bit is set if it is in over half of them.
Equal fingerprints are one class.  Each distinct fingerprint emits all values within half the radius (itself and its
64 one-bit changes); two fingerprints within the radius share one of them.  Those that share a value
link to the least of them, which is verified by counting bits, and links are contracted to components.

``deduplicated`` is for a similarity, by default shingles of WORDS words and a Jaccard similarity of LEAST: SimHash bits of
two texts of similarity s differ with probability acos(2s / (1 + s)) / pi, 0.15 at 0.8, so no radius that 64 bits allow
would do.  It takes PARTS fingerprints of PART_BITS bits, each with its ball of one bit: two texts meet if one of the
parts differs in RADIUS bits at most.  Texts with an equal part are linked to the least of them before balls are made, so that
a large group of copies makes few pairs; an equal part is in the balls too, so what that leaves apart meets again there.  In a
ball of TOGETHER texts or fewer, each is compared with each of another group: pairs are dropped if all bits together are too
far apart for the similarity, and then compared by whole shingle sets.  The texts of all larger balls meet by their rare
shingles instead (``rare_links``), which is exact: every pair of them that has the similarity is found, and a ball of many that are
a little less alike makes few pairs.  A pair shares a ball with probability 0.918 at a similarity of 0.8, 0.989 at 0.85, 0.9998
at 0.9 and more above (``meeting``), and more in larger groups.  Full balls lose nothing, they only make more texts meet the exact way.

Cases.  Null or empty text, or no words: fingerprint zero, linked like any other.  Repeated rows or ids: a row each; the
component's id is the least doc_id in it.  Null doc_id: takes part, but is never the least; a component of nulls only has
a null id.  Empty table: empty result.  Other columns are ignored, or kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import NOT_SPACE, Block, blocks, gram_hashes, grouped_rank, mixed, only, set_aside, small_batches, span_hashes, spool
from cartoflow.llm.shards import PLACE, SHARD, at_places, spool_rows
from cartoflow.operators.components import components

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Fewer shingles of one length than this are hashed one by one.
FEW = 24
#: Differing bits of linked fingerprints; balls of half of it are emitted.
RADIUS = 2
#: Of ``deduplicated``: words of a shingle, least similarity, fingerprints and the bits of each.
WORDS, LEAST, PARTS, PART_BITS = 5, 0.8, 20, 32
#: Texts of a ball that are compared each with each; those of larger ones meet by rare shingles.
TOGETHER = 9
#: Counters of shingles, by which rare ones are told; their number bounds what the driver gets.
COUNTERS = 1 << 17


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of byte spans, vectorised over the spans of each length."""
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    by_length = lengths[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], by_length[1:] != by_length[:-1]])), len(order)) if len(order) else []
    seed64 = np.uint64(seed)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows, n = order[lo:hi], int(by_length[lo])
        at = starts[rows]
        if hi - lo < FEW:
            for row, a in zip(rows.tolist(), at.tolist(), strict=True):
                out[row] = xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed)
            continue
        left = n
        if n >= 32:
            acc = [seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1)]
            acc = [np.full(len(at), x % (1 << 64), np.uint64) for x in acc]
            while left >= 32:
                acc = [_round(x, u64[at + 8 * i]) for i, x in enumerate(acc)]
                at, left = at + 32, left - 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
        else:
            h = np.full(len(at), seed64 + _P5, np.uint64)
        h = h + np.uint64(n)
        while left >= 8:
            h = _rotl(h ^ _round(np.uint64(0), u64[at]), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotl(h ^ (u32[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = _rotl(h ^ (data[at].astype(np.uint64) * _P5), 11) * _P1
            at = at + 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text (``counts`` hashes each, in order) the bits that are set in over half of its hashes.

    Four bits are counted at once in lanes of 16 bits, over pieces of at most 60,000 hashes.
    """
    piece = 60_000
    pieces = np.maximum(1, -(-counts // piece))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    owner = np.repeat(np.arange(len(counts)), pieces)
    starts = first[owner] + piece * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if not full.any():
        return out
    starts = starts[full[owner]]
    heads = np.concatenate([[0], np.cumsum(pieces[full])])[:-1]
    for b in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & np.uint64(0x0001000100010001), starts)
        for lane in range(4):
            bits = np.add.reduceat((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF), heads).astype(np.int64)
            out[full] |= (2 * bits > counts[full]).astype(np.uint64) << np.uint64(b + 16 * lane)
    return out


def fingerprints(block: Block, words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its shingles of ``words`` words (a shorter text: all its words; none: zero)."""
    data = block.lower()
    starts, ends, owners = block.words(data, NOT_SPACE)
    counts = block.per_text(owners)
    if not len(starts):
        return np.zeros(block.n, np.uint64)
    kept = NOT_SPACE[data]
    kept[ends], data[ends] = True, 0x20  # the byte after a word, a space from now on; what else is white goes
    lengths = ends - starts
    data, at = data[kept], np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    first = np.concatenate([[0], np.cumsum(counts)])
    n_shingles = np.where(counts == 0, 0, np.maximum(1, counts - words + 1))
    text = np.repeat(np.arange(block.n), n_shingles)
    head = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    last = np.minimum(head + words, first[text + 1]) - 1
    return majority(xxh64(data, at[head], at[last] + lengths[last] - at[head], seed), n_shingles)


def fingerprint_table(docs: DataFrame, words: int = 3) -> DataFrame:
    """Spooled: doc_id, text_hash, fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            kept = rows.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(fingerprints(block, words).view(np.int64))], names=[*kept.schema.names, "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spool(only(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(each, f"doc_id {kind}, text_hash long, fp long"))


def ball_links(distinct: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp): links (a, b) that join all that differ in RADIUS bits or fewer.

    All that share a value are within the radius of each other, so links to the least of them lose nothing.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    variants = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = variants.withColumn("a", F.min("fp").over(Window.partitionBy("variant"))).where("a <> fp")
    return met.select("a", F.col("fp").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def linked(docs: DataFrame, words: int = 3) -> DataFrame:
    """Per row: doc_id, text_hash, fp, root (a fingerprint of its component, the least), component_id."""
    rows = fingerprint_table(docs, words)
    classes = spool(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(ball_links(classes.select("fp")))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = spool(classes)
    ids = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(classes.select("fp", "root").join(ids, "root"), "fp")


def hex64(fp) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -------------------------------------------------------------------------------------------------- by similarity


def shingles(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash), ordered by text."""
    data = block.lower()
    starts, ends, owners = block.words(data, NOT_SPACE)
    hashes, counts = span_hashes(data, starts, ends), block.per_text(owners)
    first = np.cumsum(counts) - counts
    of, found = [], []
    for k in range(1, words + 1):
        grams = gram_hashes(hashes, k)
        at = np.flatnonzero(owners[: len(grams)] == owners[k - 1 :]) if k == words and len(grams) else first[counts == k] if k < words else np.zeros(0, np.int64)
        of.append(owners[at])
        found.append(mixed(grams[at] + np.uint64(k)))
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    return of[fresh], found[fresh]


def similarities(a: Block, b: Block, words: int = WORDS) -> np.ndarray:
    """Jaccard similarity of text i of both blocks; 1 where neither has a shingle."""
    (of_a, x), (of_b, y) = shingles(a, words), shingles(b, words)
    of, found = np.concatenate([of_a, of_b]), np.concatenate([x, y])
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    shared = np.bincount(of[1:][(of[1:] == of[:-1]) & (found[1:] == found[:-1])], minlength=a.n) if len(of) else np.zeros(a.n)
    both = np.bincount(of, minlength=a.n) - shared
    return np.where(both > 0, shared / np.maximum(1, both), 1.0)


def meeting(similarity: float, parts: int = PARTS) -> float:
    """Probability that two texts of about one length and that similarity meet."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return 1 - (1 - sum(math.comb(PART_BITS, k) * p**k * (1 - p) ** (PART_BITS - k) for k in range(RADIUS + 1))) ** parts


def part_prints(block: Block, words: int = WORDS, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many distinct shingles, and ``parts`` fingerprints, two in a long."""
    of, found = shingles(block, words)
    n = block.per_text(of)
    seeds = mixed(np.arange(1, -(-parts // 2) + 1, dtype=np.uint64))
    return n, np.stack([majority(mixed(found ^ seed), n) for seed in seeds], 1)


def _values(classes: DataFrame, parts: int, *columns: str) -> DataFrame:
    """The columns with each part's value, parts told apart."""
    lane = lambda i: F.shiftright(F.col("prints")[i // 2], 32 * (i % 2)).bitwiseAND(F.lit((1 << PART_BITS) - 1)) + F.lit(i << 32)
    return classes.select(*columns, F.explode(F.array(*[lane(i) for i in range(parts)])).alias("value"))


def _near_enough(pairs: DataFrame, classes: DataFrame, key: str, least: float, parts: int) -> DataFrame:
    """The pairs (x, y) of keys, as pairs (a, b) of ids that neither size nor bits keep apart."""
    one = lambda k, i: classes.select(F.col(key).alias(k), F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("prints").alias(f"p{i}"))
    both = pairs.join(one("x", "a"), "x").join(one("y", "b"), "y")
    apart = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(-(-parts // 2))), F.lit(0))
    bits, p = 64 * -(-parts // 2), math.acos(2 * least / (1 + least)) / math.pi
    return spool(both.where((F.least("na", "nb") >= least * F.greatest("na", "nb")) & (apart <= bits * p + 6 * math.sqrt(bits * p * (1 - p)))).select("a", "b"))


def part_links(classes: DataFrame, least: float = LEAST, parts: int = PARTS) -> DataFrame:
    """Pairs (a, b) of texts (id, n, prints) with an equal part, each with the least of them."""
    met = _values(classes, parts, "id").withColumn("x", F.min("id").over(Window.partitionBy("value"))).where("x <> id")
    return _near_enough(met.select("x", F.col("id").alias("y")).distinct(), classes, "id", least, parts)


_UPPER = -(1 << 32)


def _coded(classes: DataFrame) -> DataFrame:
    """Texts (id, root, ...) with one number for both, the upper half of the root and the lower half of the id: all ids
    are hashes."""
    return classes.withColumn("code", F.col("root").bitwiseAND(F.lit(_UPPER)).bitwiseOR(F.col("id").bitwiseAND(F.lit(0xFFFFFFFF))))


def _apart(x: str, y: str) -> "F.Column":
    return F.col(x).bitwiseAND(F.lit(_UPPER)) != F.col(y).bitwiseAND(F.lit(_UPPER))


def balls(classes: DataFrame, parts: int = PARTS) -> DataFrame:
    """(variant, code, size): values of the balls of texts (code, prints) that more than one root has, and how many texts
    each has.  Few values are left here."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(PART_BITS)])
    variants = _values(classes, parts, "code").select("code", F.explode(F.transform(flips, lambda x: F.col("value").bitwiseXOR(x))).alias("variant"))
    ball = Window.partitionBy("variant")
    met = variants.withColumns({"lo": F.min("code").over(ball), "hi": F.max("code").over(ball), "size": F.count("*").over(ball)})
    return spool(met.where(_apart("lo", "hi")).select("variant", "code", "size"))


def few_links(met: DataFrame, classes: DataFrame, least: float = LEAST, parts: int = PARTS) -> DataFrame:
    """Pairs (a, b): each text of a ball of at most TOGETHER with all others of other roots."""
    ordered = Window.partitionBy("variant").orderBy("code")
    others = {f"before_{k}": F.lag("code", k).over(ordered) for k in range(1, TOGETHER)}
    pairs = met.where(F.col("size") <= TOGETHER).withColumns(others).select(F.col("code").alias("y"), F.explode(F.array(*others)).alias("x"))
    return _near_enough(pairs.where(F.col("x").isNotNull() & _apart("x", "y")).select("x", "y").distinct(), classes, "code", least, parts)


def rare_prefixes(texts: DataFrame, least: float = LEAST, words: int = WORDS) -> DataFrame:
    """Spooled: (id, n, at, gram), the rarest shingles of each of the texts (id, text), as many as the similarity needs, with their
    places in the order of rareness.

    Two sets with a similarity of t share one of the first n - ceil(t * n) + 1 of both, in whatever order, if it is one for
    all; here it is by counters that several shingles have in common, then by hash.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, block in blocks(batches, "text"):
            total += np.bincount((shingles(block, words)[1] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["counter", "n"])

    found = texts.mapInArrow(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["counter"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    counts = texts.sparkSession.sparkContext.broadcast(counts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            of, grams = shingles(block, words)
            order = np.lexsort((grams, counts.value[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)], of))
            of, grams, n = of[order], grams[order], block.per_text(of)
            at = grouped_rank(of)
            kept = np.flatnonzero(at <= n[of] - np.ceil(n[of] * least - 1e-9).astype(np.int64))
            ids = rows.column(rows.schema.get_field_index("id")).to_numpy()
            of = of[kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(n[of]), pa.array(at[kept]), pa.array(grams[kept].view(np.int64))], names=["id", "n", "at", "gram"])

    return spool(texts.mapInArrow(each, "id long, n long, at long, gram long"))


def rare_links(texts: DataFrame, rooted: Callable[[DataFrame | None], DataFrame], least: float = LEAST, words: int = WORDS) -> DataFrame:
    """Links (a, b) that join all of the texts (id, text) with the similarity; ``rooted`` tells (id, root) by links so far and more.

    Those that share a rare shingle are held against the least of them first, so that large groups of near copies are of one
    root when what is still apart is compared, all of it.
    """
    rare = rare_prefixes(texts, least, words)
    small = lambda a, b: F.least(a, b) >= least * F.greatest(a, b) - 1e-9
    now = rare.join(rooted(None), "id")
    head = F.min(F.struct("id", "root", "n")).over(Window.partitionBy("gram"))
    first = now.withColumn("h", head).where((F.col("h.root") != F.col("root")) & small("h.n", "n")).select(F.col("h.id").alias("a"), F.col("id").alias("b")).distinct()
    links = similar_pairs(first, texts, least, words)
    now = rare.join(rooted(links), "id")
    # Of shingles that two roots have by now: after the first one that a pair shares, it can share no more than is left of both.
    roots = Window.partitionBy("gram")
    now = spool(now.withColumns({"lo": F.min("root").over(roots), "hi": F.max("root").over(roots)}).where("lo <> hi").drop("lo", "hi"))
    side = lambda x: now.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "root", "n", "at")])
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = rest >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b"))
    met = side("a").join(side("b").withColumnRenamed("gram", "gram_b"), (F.col("gram") == F.col("gram_b")) & apart & small("n_a", "n_b") & enough)
    return links.union(similar_pairs(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), texts, least, words))


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float = LEAST, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have the similarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks([batch], "ta"):
                for part, other in blocks([rows], "tb"):
                    mine = block if part.num_rows == rows.num_rows else Block([(x or "").encode() for x in part.column("ta").to_pylist()])
                    yield part.select(["a", "b"]).filter(pa.array(similarities(mine, other, words) >= least))

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return spool(both.mapInArrow(each, "a long, b long"))


def deduplicated(docs: DataFrame, least: float = LEAST, words: int = WORDS, parts: int = PARTS) -> DataFrame:
    """One document of each group of similar ones, all columns: the least doc_id, of equal ids the first row; nulls last."""
    small_batches(docs.sparkSession)
    docs, named = set_aside(docs, "doc_id", "text")
    base = spool_rows(docs.withColumn("text_hash", F.xxhash64("text")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            n, prints = part_prints(block, words, parts)
            size = prints.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * block.n + 1, size, dtype=np.int32)), pa.array(prints.view(np.int64).ravel()))
            kept = rows.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n), lists], names=[*kept.schema.names, "n", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spool(base.select("doc_id", SHARD, PLACE, "text_hash", "text").mapInArrow(each, f"doc_id {kind}, {SHARD} long, {PLACE} long, text_hash long, n long, prints array<long>"))
    choice = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", SHARD, PLACE)
    # Equal texts are one class; a copy that a third of all documents are is one row a partition here.
    classes = spool(rows.groupBy(F.col("text_hash").alias("id")).agg(F.min(choice).alias("k"), F.first("n").alias("n"), F.first("prints").alias("prints")))

    def texts_of(ids: DataFrame) -> DataFrame:
        """Spooled: (id, text)."""
        return spool(at_places(base.select("text_hash", "text", SHARD, PLACE), ids.join(classes, "id").select(f"k.{SHARD}", f"k.{PLACE}")).select(F.col("text_hash").alias("id"), "text"))

    def similar(pairs: DataFrame) -> DataFrame:
        return similar_pairs(pairs, texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), least, words)

    def rooted(links: DataFrame) -> DataFrame:
        return classes.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    # Equal parts first: what is one group by then needs no pairs within it, however many copies it has.
    links = similar(part_links(classes, least, parts))
    coded = spool(_coded(rooted(links)))
    met = balls(coded, parts)
    links = spool(links.union(similar(few_links(met, coded, least, parts))))
    crowd = spool(met.where(F.col("size") > TOGETHER).select("code").distinct().join(coded, "code").select("id"))
    if crowd.take(1):
        links = links.union(rare_links(texts_of(crowd), lambda more: rooted(links if more is None else links.union(more)).select("id", "root"), least, words))
    first = rooted(links).groupBy("root").agg(F.min("k").alias("k"))
    return named(at_places(base, first.select(f"k.{SHARD}", f"k.{PLACE}")).select(*docs.columns))
