"""Set-similarity joins over trigrams, by an inverted index with prefix and length filters.

Grams are as in trigram indexes of databases: words of letters and digits, lower-cased, each with two blanks before and one
after it, and their distinct runs of three characters; likeness is shared grams over all grams of both.

Texts with one set of grams are a class, and only classes are compared.  The grams of a class are ordered by how rare they
are.  Two sets with a Jaccard likeness of t share a gram among the first n - ceil(t * n) + 1 of both (else too few are left),
and neither is smaller than t times the other: so only those prefixes go into the index, sizes are part of the join, and what
meets is measured by whole sets.  A gram shared at places i and j of both orders is met only if what is left behind them is
enough.  The rarest grams make short lists, and a list that is long has only classes of different texts.  Texts without a
gram are like nothing.

Where texts are made of few grams even the rarest lists are long, and what meets is nearly all pairs.  Links are then counted
by products of packs of classes, gram by gram: the same counts, and no pair leaves its task.  The most like rows are found in
the same way: a task holds its best so far of each query, and looks at what reaches the last of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.store.shared import spool


#: Likenesses that the most like rows are asked for in turn, while fewer than k are found.
STEPS = (0.8, 0.6, 0.45)
#: What lists may hold of pairs before products are thought of, how many sums of a product cost as much as one of those pairs,
#: and grams of a product at most.
MET, SUMS, COLUMNS = 10_000_000, 4096, 1 << 16
#: Classes of a pack, its cells (classes by grams) at most, and classes that are multiplied with a pack at once.
PACK, CELLS, STRIP = 8192, 1 << 25, 1024
#: Packs that a task holds one after the other against its queries, sets of the first that say what to look for, and pairs of
#: query and set that are sorted at once.
RUN, SAMPLE, HITS = 4, 1024, 1 << 20
#: Likenesses are compared in millionths.  Different sets of fewer grams than these have less than one that rounds to 1.
ONE = 1_000_000

_WORD = r"[\p{L}\p{N}]+"


def padded_grams(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(words, of))))


def classes(rows: DataFrame, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, class), a row for each row that has a gram, and (class, grams); a class is known by its least id."""
    named = rows.select(F.col(id_).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.lower("text").rlike(_WORD))
    # Grams are made once a text, and after a shuffle: a small file of many rows is one task.
    grams = spool(named.groupBy("text").agg(F.min("id").alias("id")).select("text", "id", padded_grams(F.col("text")).alias("grams")))
    sets = spool(grams.groupBy("grams").agg(F.min("id").alias("class")))
    members = named.join(grams.join(sets, "grams").select("text", "class"), "text").select("id", "class")
    return spool(members), sets.select("class", "grams")


def _prefixes(sets: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(class, n, i, gram): the rarest grams of each set and their places, as many as a likeness of ``least`` needs.  Ceilings
    allow for the last digits of products."""
    grams = sets.select("class", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(counts, "gram", "left")
    ordered = grams.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
    keep = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    return ordered.select("class", "n", F.posexplode(F.slice("g", F.lit(1), F.least(keep, F.col("n")))).alias("i", "g")).select("class", "n", "i", "g.gram")


def like_pairs(left: DataFrame, right: DataFrame, least: float, by_size: bool = False) -> DataFrame:
    """(a, b, likeness) of classes (class, grams) of both sides with a likeness of ``least`` (over 0) or more.  ``by_size`` is
    for short sets: both sizes are part of the key then, so a gram that all sets have is in the index of few."""
    if not 0 < least <= 1:
        raise ValueError("likeness must be over 0 and at most 1")
    grams = lambda df: df.select(F.explode("grams").alias("gram"))
    # What the left side has not is never met; it is as rare as a gram can be, and need not be counted.
    counts = spool(grams(right).join(grams(left).distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df")))
    a = _prefixes(left, counts, least).select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), "gram")
    b = _prefixes(right, counts, least).select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), "gram")
    sized = (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)
    needed = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    if by_size:
        size = lambda df, c: spool(df.select(F.size("grams").alias(c)).distinct())
        a = a.join(F.broadcast(size(right, "nb")), sized & (F.col("na") - F.col("ia") >= needed))
        b = b.join(F.broadcast(size(left, "na")), sized & (F.col("nb") - F.col("ib") >= needed)).join(counts.select("gram"), "gram", "left_semi")
        met = a.join(b, ["gram", "na", "nb"]).select("a", "b").distinct()
    else:
        enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= needed
        met = a.join(b, "gram").where(sized & enough).select("a", "b").distinct()
    whole = met.join(left.select(F.col("class").alias("a"), F.col("grams").alias("ga")), "a").join(right.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return whole.select("a", "b", (both / (F.size("ga") + F.size("gb") - both)).alias("likeness")).where(F.col("likeness") >= least - 1e-12)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with their sets as bytes: rows of each class, sizes of sets, and grams."""
    for batch in batches:
        for pack, sets in zip(batch.column(0), batch.column(1), strict=True):
            grams = sets.values.field("grams")
            raw = (sets.values.field("n").to_numpy().astype(np.int64), grams.value_lengths().to_numpy().astype(np.int32), grams.flatten().to_numpy().astype(np.uint16))
            yield pa.RecordBatch.from_pydict({"pack": [pack.as_py()], **{c: [x.tobytes()] for c, x in zip(("n", "sizes", "grams"), raw, strict=True)}})


def _products(least: float, columns: int):
    """Of pairs of packs: (pack, at, others), how many rows each class is linked with, itself included."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(row: dict, of: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n, sizes, grams = (np.frombuffer(row[f"{c}_{of}"], t) for c, t in (("n", np.int64), ("sizes", np.int32), ("grams", np.uint16)))
            cells = np.zeros((len(n), columns), np.float32)
            cells[np.repeat(np.arange(len(n)), sizes), grams] = 1
            return n, sizes, cells

        def told(pack: int, others: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(others)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pack, np.int64)), pa.array(at), pa.array(others[at])], names=["pack", "at", "others"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (na, sa, a), (nb, sb, b) = side(row, "a"), side(row, "b")
                of_a, of_b = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
                order = np.argsort(sa, kind="stable")
                for lo in range(0, len(order), STRIP):
                    mine = order[lo : lo + STRIP]
                    both = a[mine] @ b.T
                    like = np.empty(both.shape, bool)
                    cuts = np.flatnonzero(np.diff(sa[mine], prepend=-1, append=-1))
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        np.greater_equal(both[x:y], np.ceil((sa[mine[x]] + sb) * (least / (1 + least)) - 1e-9).astype(np.float32), out=like[x:y])
                    hit = np.flatnonzero(like.ravel())
                    r = hit // len(nb)
                    c = hit - r * len(nb)
                    np.add.at(of_a, mine[r], nb[c])
                    np.add.at(of_b, c, na[mine[r]])
                yield told(row["pack_a"], of_a)
                if row["pack_a"] != row["pack_b"]:
                    yield told(row["pack_b"], of_b)

    return each


def _others_by_products(sets: DataFrame, sizes: DataFrame, least: float, classes_: int, grams: int) -> DataFrame:
    """(class, others) of every class, by products of all packs of classes; each two packs meet once."""
    numbers = spool(sets.select(F.explode("grams").alias("gram")).distinct().withColumn("number", F.row_number().over(Window.orderBy("gram")) - 1))
    packs = -(-classes_ // max(1, min(PACK, CELLS // grams)))
    coded = sets.select("class", F.explode("grams").alias("gram")).join(numbers, "gram").groupBy("class").agg(F.collect_list("number").alias("grams")).join(sizes, "class")
    whole = spool(coded.groupBy(F.pmod(F.xxhash64("class"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("class", "n", "grams")).alias("sets")))
    raw = spool(whole.select("pack", "sets").mapInArrow(_packed, "pack long, n binary, sizes binary, grams binary"))
    # Pack i meets i and the half of the packs behind it, so all have about as many partners.
    ahead = F.sequence(F.lit(0), F.when(F.lit(packs % 2 == 0) & (F.col("pack_a") >= packs // 2), F.lit(packs // 2 - 1)).otherwise(F.lit(packs // 2)))
    met = raw.select(F.col("pack").alias("pack_a")).select("pack_a", F.explode(ahead).alias("d")).select("pack_a", F.pmod(F.col("pack_a") + F.col("d"), F.lit(packs)).alias("pack_b"))
    tasks = min(4096, packs * (packs // 2 + 1))
    side = lambda of: met.join(raw.select(F.col("pack").alias(f"pack_{of}"), *[F.col(c).alias(f"{c}_{of}") for c in ("n", "sizes", "grams")]), f"pack_{of}").repartition(tasks, "pack_a", "pack_b")
    pairs = side("a").join(side("b"), ["pack_a", "pack_b"])
    counted = pairs.mapInArrow(_products(least, grams), "pack long, at long, others long").groupBy("pack", "at").agg(F.sum("others").alias("others"))
    names = whole.select("pack", F.posexplode("sets.class").alias("at", "class")).withColumn("at", F.col("at").cast("long"))
    return names.join(counted, ["pack", "at"]).join(sizes, "class").select("class", (F.col("others") - F.col("n")).alias("others"))


def _few_grams(met: float, asked: int, classes_: int, grams: int) -> bool:
    """Whether lists with so many pairs cost more than products of all sets."""
    return met > MET and met * SUMS > float(asked) * classes_ * grams and grams <= COLUMNS


def _ordered_packs(sets: DataFrame, numbers: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(pack, at, class), in the order of classes, and packs as bytes, of sets (class, n, grams)."""
    coded = spool(sets.select("class", "n", F.explode("grams").alias("gram")).join(numbers, "gram").groupBy("class", "n").agg(F.collect_list("number").alias("grams")))
    packs = max(1, -(-coded.count() // size))
    whole = coded.repartitionByRange(packs, "class").groupBy(F.spark_partition_id().cast("long").alias("pack")).agg(F.sort_array(F.collect_list(F.struct("class", "n", "grams"))).alias("sets"))
    whole = spool(whole)
    raw = spool(whole.select("pack", "sets").mapInArrow(_packed, "pack long, n binary, sizes binary, grams binary"))
    return whole.select("pack", F.posexplode("sets.class").alias("at", "class")), raw


class _Best:
    """The k best classes so far of each query of a pack: likeness in millionths, place (it ascends with the class), rows."""

    def __init__(self, size: np.ndarray, k: int, least: float):
        self.size, self.k, self.least = size, k, least
        self.like = np.full((len(size), k), -1, np.int64)
        self.place, self.n = np.zeros_like(self.like), np.zeros_like(self.like)
        self.floor = np.full(len(size), int(least * ONE), np.int64)
        self.fresh = True

    def needed(self, at: slice, sizes: np.ndarray) -> np.ndarray:
        """Grams that a query must share with a set of each size, less a half."""
        f = np.maximum(self.floor[at, None] - 0.5, 0) / ONE - 1e-9
        return (np.ceil((self.size[at, None] + sizes) * (f / (1 + f)) - 1e-6) - 0.5).astype(np.float32)

    def look(self, at: slice, both: np.ndarray, sizes: np.ndarray) -> None:
        """Take what some sets of the first pack reach as the floor."""
        some = np.linspace(0, len(sizes) - 1, min(SAMPLE, len(sizes))).astype(int)
        if len(some) >= self.k:
            of = both[:, some]
            like = np.partition(of / (self.size[at, None] + sizes[some] - of), len(some) - self.k, axis=1)[:, len(some) - self.k]
            self.floor[at] = np.maximum(self.floor[at], (like * ONE).astype(np.int64) - 2)

    def add(self, at: slice, row: np.ndarray, both: np.ndarray, sizes: np.ndarray, place: np.ndarray, n: np.ndarray) -> None:
        either = self.size[at][row] + sizes - both
        good = both >= (self.least - 1e-12) * either
        like = (2 * ONE * both + either) // (2 * either)  # rounded half up
        old, j = np.nonzero(self.like[at] >= 0)
        row = np.concatenate([old, row[good]])
        like, place, n = (np.concatenate([a[at][old, j], b[good]]) for a, b in ((self.like, like), (self.place, place), (self.n, n)))
        order = np.lexsort((place, -like, row))
        row, like, place, n = row[order], like[order], place[order], n[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        keep = turn < self.k
        row, turn = row[keep], turn[keep]
        for a, b in ((self.like, like), (self.place, place), (self.n, n)):
            a[at][row, turn] = b[keep]
        # Rows of classes count: what is less like than the k-th row is not wanted.
        full = np.cumsum(self.n[at], axis=1) >= self.k
        last = np.take_along_axis(self.like[at], full.argmax(1)[:, None], 1)[:, 0]
        self.floor[at] = np.where(full[:, -1], np.maximum(self.floor[at], last), self.floor[at])

    def told(self, pack: int) -> pa.RecordBatch:
        i, j = np.nonzero((self.like >= self.floor[:, None]) & (self.like >= 0))
        place = self.place[i, j]
        arrays = (np.full(len(i), pack, np.int64), i.astype(np.int32), place >> 32, (place & 0xFFFFFFFF).astype(np.int32), self.like[i, j] / ONE)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["pack_a", "at_a", "pack_b", "at_b", "likeness"])


def _nearest(k: int, least: float, columns: int):
    """Of pairs of packs of queries and packs of sets, the best sets of each query, kept while packs of one run follow."""

    def cells(grams: bytes, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), columns), np.float32)
        out[np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(grams, np.uint16)] = 1
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best, asked = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if of != (row["pack_a"], row["run"]):
                    if best is not None:
                        yield best.told(of[0])
                    of, best = (row["pack_a"], row["run"]), _Best(np.frombuffer(row["n_a"], np.int64), k, least)
                    asked = cells(row["grams_a"], np.frombuffer(row["sizes_a"], np.int32))
                sizes = np.frombuffer(row["sizes_b"], np.int32)
                order = np.argsort(sizes, kind="stable")
                sets, sizes, n = cells(row["grams_b"], sizes)[order].T, sizes[order].astype(np.int64), np.frombuffer(row["n_b"], np.int64)[order]
                place = (row["pack_b"] << 32) + order
                cuts = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1))
                for lo in range(0, len(asked), STRIP):
                    at = slice(lo, min(lo + STRIP, len(asked)))
                    both = asked[at] @ sets
                    if best.fresh:
                        best.look(at, both, sizes)
                    needed, like = best.needed(at, sizes[cuts[:-1]]), np.empty(both.shape, bool)
                    for g, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        np.greater_equal(both[:, x:y], needed[:, g : g + 1], out=like[:, x:y])
                    hits = np.flatnonzero(like.ravel())
                    for some in range(0, len(hits), HITS):  # where many tie, all of them are hits
                        hit = hits[some : some + HITS]
                        r = hit // len(sizes)
                        c = hit - r * len(sizes)
                        best.add(at, r, both.ravel()[hit].astype(np.int64), sizes[c], place[c], n[c])
                best.fresh = False
        if best is not None:
            yield best.told(of[0])

    return each


def _best_by_products(asked: DataFrame, sets: DataFrame, sizes: DataFrame, k: int, least: float, grams: int) -> DataFrame:
    """(a, b, likeness): of each asked set the k best classes, or so many as hold k rows."""
    numbers = spool(sets.select(F.explode("grams").alias("gram")).distinct().withColumn("number", F.row_number().over(Window.orderBy("gram")) - 1))
    pack = max(1, min(PACK, CELLS // grams))
    names_a, a = _ordered_packs(asked.withColumn("n", F.size("grams").cast("long")), numbers, pack)
    names_b, b = _ordered_packs(sets.join(sizes, "class"), numbers, pack)
    na, runs = a.count(), (b.agg(F.max("pack")).first()[0] or 0) // RUN + 1
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    tasks = min(4096, max(na, 1) * runs)
    side = lambda df, of: df.select(F.col("pack").alias(f"pack_{of}"), *[F.col(c).alias(f"{c}_{of}") for c in ("n", "sizes", "grams")])
    left = side(a, "a").withColumn("run", number(runs)).repartition(tasks, "pack_a", "run")
    right = side(b, "b").crossJoin(F.broadcast(a.select(F.col("pack").alias("pack_a")))).withColumn("run", (F.col("pack_b") / RUN).cast("int")).repartition(tasks, "pack_a", "run")
    found = left.join(right, ["pack_a", "run"]).mapInArrow(_nearest(k, least, grams), "pack_a long, at_a int, pack_b long, at_b int, likeness double")
    found = spool(found)
    found = found.join(names_b.toDF("pack_b", "at_b", "b"), ["pack_b", "at_b"]).join(names_a.toDF("pack_a", "at_a", "a"), ["pack_a", "at_a"])
    by = Window.partitionBy("a").orderBy(F.desc("likeness"), "b")
    return found.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).select("a", "b", "likeness")


def linked(rows: DataFrame, id_: str, text: str, least: float) -> DataFrame:
    """A self-join without its pairs: (id, class, n_links), how many other rows are at least so like each row's text."""
    if not 0 < least <= 1:
        raise ValueError("likeness must be over 0 and at most 1")
    members, sets = classes(rows, id_, text)
    sizes = spool(members.groupBy("class").agg(F.count("*").alias("n")))
    counts = spool(sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")))
    lists = _prefixes(sets, counts, least).groupBy("gram").agg(F.count("*").cast("double").alias("n"))
    met = lists.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    n, grams = sets.count(), counts.count()
    if _few_grams(met, n, n, grams):
        others = _others_by_products(sets, sizes, least, n, grams)
    else:
        pairs = like_pairs(sets, sets, least).where("a <> b").select(F.col("a").alias("of"), F.col("b").alias("class"))
        others = pairs.join(sizes, "class").groupBy(F.col("of").alias("class")).agg(F.sum("n").alias("others"))
    links = sizes.join(others, "class", "left").select("class", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(links, "class").select("id", "class", "n_links")


def most_like(queries: DataFrame, rows: DataFrame, id_: str, text: str, k: int, least: float = 0.3) -> DataFrame:
    """(query_id, id, likeness, position): the k rows that are most like each query, of ``least`` or more; ties by id."""
    asked, asked_sets = classes(queries, id_, text)
    members, sets = classes(rows, id_, text)
    by = Window.partitionBy("class").orderBy("id")
    sets = spool(sets)
    first = members.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).select("id", F.col("class").alias("b"))  # more of a class never come in
    first = spool(first)
    best = Window.partitionBy("a").orderBy(F.desc("likeness"), "id")
    ranked = lambda found: found.join(first, "b").withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
    counts = spool(sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")))
    n, grams = sets.count(), counts.count()
    done, rest = [], spool(asked_sets)
    # A high likeness meets few and is asked first; a query that has k rows there has its answer, as no other row is so like.
    for step in [x for x in STEPS if x > least] + [least]:
        low = max(least, step - 1e-6)  # what is rounded up to the step ties with it
        lists = lambda of: _prefixes(of, counts, low).groupBy("gram").agg(F.count("*").cast("double").alias("n"))  # noqa: B023, E731
        met = lists(rest).join(lists(sets).withColumnRenamed("n", "m"), "gram").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
        if _few_grams(met, rest.count(), n, grams):
            # A query of whose own set there are k rows needs no other.
            sizes = spool(members.groupBy("class").agg(F.count("*").alias("n")))
            own = sets.join(sizes.where(F.col("n") >= k), "class").where(F.size("grams") < ONE)
            own = spool(rest.withColumnRenamed("class", "a").join(own.withColumnRenamed("class", "b"), "grams").select("a", "b", F.lit(1.0).alias("likeness")))
            others = rest.join(own, F.col("class") == F.col("a"), "left_anti")
            done.append(spool(ranked(own.union(_best_by_products(others, sets, sizes, k, least, grams)))))
            break
        found = like_pairs(rest, sets, low).select("a", "b", F.round("likeness", 6).alias("likeness"))
        found = spool(ranked(found))
        if step == least:
            done.append(found)
            break
        full = spool(found.where((F.col("position") == k) & (F.col("likeness") >= step)).select("a"))
        done.append(found.join(full, "a", "left_semi"))
        rest = spool(rest.join(full, F.col("class") == F.col("a"), "left_anti"))
    found = reduce(DataFrame.unionByName, done)
    return asked.withColumnRenamed("id", "query_id").join(found, F.col("class") == F.col("a")).select("query_id", "id", "likeness", "position")
