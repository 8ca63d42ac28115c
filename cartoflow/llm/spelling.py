r"""Spelling variants by full neighbourhood generation.

1. Words.  Runs ``[A-Za-zÀ-ÿ]+`` with A-Z lower-cased; where NOISE divides the crc32 of ``<doc_id>:<run>``, the
   run's code point at crc32 % length goes.  Tasks count the results of LEAST code points and more themselves (in tables of
   FLUSH words at most) before the counts are shuffled.  Words found twice or more are the vocabulary.
2. Neighbourhoods.  Every word emits all distinct strings that one deletion, one replacement or one insertion over the
   observed alphabet (90 letters at most) makes of it, each once by construction: of equal letters in a row only the first
   is deleted, and a letter is inserted after its equals only.
3. Hash join.  Strings that are in the vocabulary are near words; equality says it all, so no distance is measured.  So
   that a thousand strings a word need not be shuffled, a bit filter of the vocabulary drops most of those that are in no
   place of it: it is never wrong about a word that is there.  It has BITS_A_WORD bits a word and 2**FILTER_BITS bits (32 MB)
   at most; a vocabulary beyond that shuffles more strings, with the same result.  Strings are told by polynomial hashes,
   so a letter's change is one addition; only those that pass the filter are built.
4. Forms.  A word's form is its most frequent near word, if that is RATIO times as frequent.  Counts rise by RATIO along
   forms, so chains are of log10(largest count) words at most, and pointers are doubled as often as that needs.

Cases.  Null or empty text: no words.  Null doc_id: an empty id in the hash.  Repeated rows: each counts.  Ties of form: the
least word by code points.  Empty table: empty result.  Runs of any length are whole; a long word's neighbourhood is made in
slices.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import LOWER, mixed, only, small_batches, spool

LEAST, SEEN, NOISE, RATIO = 7, 2, 31, 10
#: Words of a task's table of counts; strings that are made at once.
FLUSH, AT_ONCE = 200_000, 1 << 20
#: Words whose neighbourhoods one task makes, about.
A_TASK = 30_000
#: Bits of the filter a word and at most (as a power of 2), and those of its segments.
BITS_A_WORD, FILTER_BITS, SEGMENT_BITS = 32, 28, 16
PROBES = 3

_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return batch

    lower = LOWER.tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for match in _RUNS.finditer(text.as_buffer().to_pybytes().translate(lower).decode()):
                word = match.group()
                h = zlib.crc32(word.encode(), start)
                if h % NOISE == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST:
                        continue
                found[word] += 1
                if len(found) >= FLUSH:
                    yield out()
    if found:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words with their counts over all documents."""
    small_batches(docs.sparkSession)
    rows = only(docs, doc_id="doc_id", text="text").mapInArrow(_counts, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)


# ------------------------------------------------------------------------------------------------- neighbourhoods


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


class Words:
    """Some words as code points, with what the hashes of their neighbourhoods are made of."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.first[self.owner]
        self.power = _powers(int(self.sizes.max(initial=0)) + 2)
        terms = self.codes * self.power[self.place]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.before = sums[:-1] - sums[self.first][self.owner]
        self.whole = sums[self.first + self.sizes] - sums[self.first]

    def hashes(self) -> np.ndarray:
        return mixed(self.whole)

    def neighbours(self, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Kind of change, and per string: word, place, letter, hash; every string of a neighbourhood once."""
        letters = alphabet.astype(np.uint64)
        none = np.zeros(0, np.uint64)
        same = np.zeros(len(self.codes), bool)
        same[1:] = (self.codes[1:] == self.codes[:-1]) & (self.place[1:] > 0)
        at = np.flatnonzero(~same)
        after = self.whole[self.owner[at]] - self.before[at] - self.codes[at] * self.power[self.place[at]]
        yield "delete", self.owner[at], self.place[at], none, mixed(self.before[at] + after * np.uint64(_INVERSE))
        step = max(1, AT_ONCE // max(1, len(letters)))
        for lo in range(0, len(self.codes), step):
            part = slice(lo, lo + step)
            owner, place, codes, power = self.owner[part], self.place[part], self.codes[part], self.power[self.place[part]]
            rows, which = np.nonzero(codes[:, None] != letters)
            yield "replace", owner[rows], place[rows], letters[which], mixed(self.whole[owner[rows]] + (letters[which] - codes[rows]) * power[rows])
            moved = (self.whole[owner] - self.before[part]) * np.uint64(_BASE) + self.before[part]
            yield "insert", owner[rows], place[rows], letters[which], mixed(moved[rows] + letters[which] * power[rows])
        for lo in range(0, len(self.words), step):
            owner = np.repeat(np.arange(lo, min(lo + step, len(self.words))), len(letters))
            which = np.tile(letters, len(owner) // max(1, len(letters)))
            yield "insert", owner, self.sizes[owner], which, mixed(self.whole[owner] + which * self.power[self.sizes[owner]])

    def built(self, kind: str, owner: np.ndarray, place: np.ndarray, letter: np.ndarray) -> list[str]:
        words = map(self.words.__getitem__, owner.tolist())
        if kind == "delete":
            return [w[:i] + w[i + 1 :] for w, i in zip(words, place.tolist(), strict=True)]
        skip = int(kind == "replace")
        return [w[:i] + chr(a) + w[i + skip :] for w, i, a in zip(words, place.tolist(), letter.tolist(), strict=True)]


class Filter:
    """Bits of the vocabulary by hash: a segment by the first bits, PROBES bits in it by the last."""

    def __init__(self, segments: int):
        self.shift = 64 - (segments.bit_length() - 1)
        self.bits = np.zeros(segments << SEGMENT_BITS >> 3, np.uint8)

    @staticmethod
    def offsets(hashes: np.ndarray, probe: int) -> np.ndarray:
        return (hashes >> np.uint64(13 * probe)) & np.uint64((1 << SEGMENT_BITS) - 1)

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(self.shift) if self.shift < 64 else np.zeros_like(hashes)

    def having(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be the vocabulary's."""
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            h = hashes[left]
            bit = (self.segment(h) << np.uint64(SEGMENT_BITS)) + self.offsets(h, probe)
            left = left[(self.bits[(bit >> np.uint64(3)).astype(np.intp)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return left


def segments_for(n: int) -> int:
    return 1 << min(FILTER_BITS - SEGMENT_BITS, max(0, (n * BITS_A_WORD - 1).bit_length() - SEGMENT_BITS))


def filter_of(words: DataFrame, n: int) -> Filter:
    """The filter, made by segment on the executors; the driver gets its bits (32 MB at most)."""
    out = Filter(segments_for(n))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = Words(batch.column("word").to_pylist()).hashes()
            yield pa.RecordBatch.from_arrays([pa.array(out.segment(h).astype(np.int64)), pa.array(h.view(np.int64))], names=["segment", "h"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, h = batch.column("segment").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            order = np.argsort(segment, kind="stable")
            cuts = np.flatnonzero(np.diff(segment[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                mine = bits.setdefault(int(segment[rows[0]]), np.zeros(1 << SEGMENT_BITS >> 3, np.uint8))
                for probe in range(PROBES):
                    bit = Filter.offsets(h[rows], probe)
                    np.bitwise_or.at(mine, (bit >> np.uint64(3)).astype(np.intp), np.left_shift(1, (bit & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([x.tobytes() for x in bits.values()], pa.binary())], names=["segment", "bits"])

    rows = words.select("word").mapInArrow(hashed, "segment long, h long").repartition("segment").mapInArrow(gathered, "segment long, bits binary")
    size = 1 << SEGMENT_BITS >> 3
    for batch in rows.toArrow().to_batches():
        for segment, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.bits[segment * size : (segment + 1) * size] |= np.frombuffer(bits, np.uint8)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, near, near_n): every pair of words of the table (word, n) that one change of a letter parts, both ways."""
    spark = words.sparkSession
    small_batches(spark)
    letters = words.select(F.explode(F.split("word", "")).alias("a")).where("a <> ''").distinct()
    alphabet, n = np.array(sorted(ord(r[0]) for r in letters.collect()), np.uint64), words.count()
    shared = spark.sparkContext.broadcast(filter_of(words, n))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = Words(batch.column("word").to_pylist())
            for kind, owner, place, letter, hashes in mine.neighbours(alphabet):
                at = shared.value.having(hashes)
                if len(at):
                    near = mine.built(kind, owner[at], place[at], letter[at] if len(letter) else letter)
                    yield pa.RecordBatch.from_arrays([pa.array(map(mine.words.__getitem__, owner[at].tolist()), pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    made = words.select("word").repartition(1 + n // A_TASK, "word").mapInArrow(each, "word string, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("shuffle_hash"), "near")


# ------------------------------------------------------------------------------------------------------------ forms


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """Rows (word, root) of (word, form): forms followed to the last, by doubling; ``largest`` is the greatest count."""
    chain = max(1, int(math.log10(max(largest, SEEN) / SEEN)) + 1)
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range((chain - 1).bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = spool(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return links


def grouped(docs: DataFrame) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n."""
    words = spool(vocabulary(docs))
    near = near_words(words).select("word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")).alias("best"))
    own = words.select("word", "n", F.lit(None).cast(near.schema["best"].dataType).alias("best"))
    rows = own.union(near).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    formed = -F.col("best.n") >= RATIO * F.col("n")
    rows = spool(rows.select("word", "n", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")))
    found = roots(rows.where("form IS NOT NULL"), rows.agg(F.max("n")).first()[0] or 0)
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
