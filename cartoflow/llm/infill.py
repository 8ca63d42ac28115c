r"""Fill-in-the-middle by a parallel scan with a finite automaton.

Units are ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``: a word with the white space before it, and white space at
the end of the text.  An automaton of four states reads bytes, counts word ends (the last unit ends with the text, so there
are as many units as ends and one more, if there is any text) and the markers ``<P>``, ``<S>``, ``<M>``.

1. Bytes are dealt to strips of STRIP bytes.  All strips advance together, each from all four states, and give a
   transition function (state at its end by state at its start) and counts by start state.
2. Functions of neighbouring strips are composed in log(n) rounds (composition is associative), which gives each strip's
   entry state, and with it the counts before it.
3. A cut is the k-th end: a search in the running counts finds its strip, and a walk from the entry state the byte.

Texts of CHUNK bytes at most are one piece: one Arrow UDF does all three steps and only numbers come back from Python.
Longer ones are cut to chunks, written as rows of the shared folder, so that many tasks scan one document.  Each chunk
emits its function and counts by start state; a document's chunks (some bytes each, of a text of 2 GB at most) are composed
by the same rounds; only the chunks that hold a cut are read again, by address.  Texts are never shuffled.  The outputs are
built and hashed by the JVM.

Cases.  Null or empty text: no units, plain, the hash of nothing.  White space alone: one unit.  Null doc_id: hashed as an
empty id.  Repeated rows: a row each, with equal results.  Empty table: empty result.  NUL bytes are word bytes.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import only, small_batches, spool
from cartoflow.llm.shards import PLACE, SHARD, at_places, spool_rows

#: Bytes of a chunk and of a strip, and of texts that are scanned together.
CHUNK, STRIP, TOGETHER = 1 << 15, 64, 1 << 20
#: Percent of documents that get a middle, and of these with the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42

#: States: after white space or at the start; in a word; in a word after "<"; after "<" and a marker's letter.
SPACE, WORD, OPEN, LETTER = range(4)
STATES = 4


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte (0 is padding), next state by class and state, and what is counted (ends + 256 * markers)."""
    kind = np.full(256, 5, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 1
    kind[ord("<")], kind[ord(">")] = 2, 4
    kind[[ord(x) for x in "PSM"]] = 3
    following = np.array([[0, 1, 2, 3], [SPACE] * 4, [OPEN] * 4, [WORD, WORD, LETTER, WORD], [WORD] * 4, [WORD] * 4], np.uint8)
    counted = np.zeros((6, STATES), np.uint16)
    counted[1, 1:] = 1
    counted[4, LETTER] = 256
    return kind, following.ravel(), counted.ravel()


KIND, FOLLOWING, COUNTED = _automaton()


def composed(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of transition functions (rows) the composition from its segment's first row up to each; ``first`` by row."""
    out, d, at = steps.astype(np.intp), 1, np.arange(len(steps))
    while d < len(steps):
        rows = np.flatnonzero(at - d >= first)
        if not len(rows):
            break
        out[rows] = np.take_along_axis(out[rows], out[rows - d], 1)
        d *= 2
    return out


class Folded(NamedTuple):
    """Pieces in their order, by segments: entry states, counts and characters before each piece (in its segment), and
    the segments' end states and totals; all but characters by the segment's start state."""

    first: np.ndarray
    entry: np.ndarray
    upto: np.ndarray
    chars_before: np.ndarray
    after: np.ndarray
    ends: np.ndarray
    marks: np.ndarray
    chars: np.ndarray


def fold(steps: np.ndarray, ends: np.ndarray, marks: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> Folded:
    """``sizes``: pieces of each segment (one at least)."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.repeat(start, sizes)
    whole = composed(steps, first)
    entry = np.empty_like(whole)
    entry[1:] = whole[:-1]
    entry[start] = np.arange(STATES)
    upto = np.cumsum(np.take_along_axis(ends, entry, 1), 0, dtype=np.int64)
    marked = np.cumsum(np.take_along_axis(marks, entry, 1), 0, dtype=np.int64)
    of = lambda x: x[stop - 1] - np.where(start[:, None] > 0, x[np.maximum(start - 1, 0)], 0)
    running = np.cumsum(chars)
    before = running - chars
    return Folded(start, entry, upto, before - np.repeat(before[start], sizes), whole[stop - 1], of(upto), of(marked), running[stop - 1] - before[start])


class Scan:
    """Some byte strings (segments), scanned from every start state."""

    def __init__(self, raw: list[bytes]):
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        strips = np.maximum(1, -(-size // STRIP))
        data = np.frombuffer(b"".join(x.ljust(n * STRIP, b"\0") for x, n in zip(raw, strips.tolist(), strict=True)), np.uint8).reshape(-1, STRIP)
        self.kind = KIND[data]
        last = np.cumsum(strips) - 1
        fill = size - (strips - 1) * STRIP
        self.kind[last] = np.where(np.arange(STRIP) < fill[:, None], self.kind[last], 0)
        self.lead = ((data & 0xC0) != 0x80) & (self.kind > 0)
        state = np.tile(np.arange(STATES, dtype=np.uint8), (len(data), 1))
        count = np.zeros(state.shape, np.uint16)
        for column in np.ascontiguousarray(self.kind.T) * STATES:
            at = column[:, None] + state
            count += COUNTED.take(at)
            state = FOLLOWING.take(at)
        self.ends = count & 255
        self.fold = fold(state, self.ends, count >> 8, self.lead.sum(1), strips)

    def chars_to(self, segment: np.ndarray, start: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Code points of the segments before their ``k``-th word end (k from 1; it must be there)."""
        out = np.zeros(len(segment), np.int64)
        first = self.fold.first[segment]
        for s in np.unique(start).tolist():
            rows = np.flatnonzero(start == s)
            upto = self.fold.upto[:, s]
            base = np.where(first[rows] > 0, upto[np.maximum(first[rows] - 1, 0)], 0)
            strip = np.searchsorted(upto, base + k[rows])
            need = base + k[rows] - np.where(strip > 0, upto[np.maximum(strip - 1, 0)], 0)
            state = self.fold.entry[strip, s].astype(np.uint8)
            left, chars = need.copy(), self.fold.chars_before[strip].astype(np.int64)
            for column, lead in zip(self.kind[strip].T, self.lead[strip].T, strict=True):
                at = column * STATES + state
                left -= COUNTED.take(at) & 255
                chars += lead & (left > 0)
                state = FOLLOWING.take(at)
            out[rows] = chars
        return out


def _units(ends: np.ndarray, chars: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and (two rows) the unit numbers of its cuts."""
    n = ends + (chars > 0)
    cut = np.sort(np.stack([a % (n + 1), b % (n + 1)]), 0)
    return n, cut


def _blocks(raw: list[bytes]) -> Iterator[slice]:
    at = held = 0
    for i, x in enumerate(raw):
        if i > at and held + len(x) > TOGETHER:
            yield slice(at, i)
            at, held = i, 0
        held += len(x) + STRIP
    if at < len(raw):
        yield slice(at, len(raw))


_FOUND = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("marked", pa.bool_())])
_FOUND_DDL = "struct<n long, first long, second long, marked boolean>"


def found_in(raw: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units, code points before both cuts, and whether there is a marker, of whole texts."""
    scan = Scan(raw)
    ends, chars = scan.fold.ends[:, SPACE], scan.fold.chars
    n, cut = _units(ends, chars, a, b)
    at = []
    for u in cut:
        rows = np.flatnonzero((u > 0) & (u <= ends))
        where = np.where(u > ends, chars, 0)
        where[rows] = scan.chars_to(rows, np.full(len(rows), SPACE), u[rows])
        at.append(where)
    return n, at[0], at[1], scan.fold.marks[:, SPACE] > 0


def _short(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    raw = [b"" if x is None else x for x in text.cast(pa.binary()).to_pylist()]
    a, b = a.to_numpy(), b.to_numpy()
    parts = [found_in(raw[x], a[x], b[x]) for x in _blocks(raw)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] if parts else [pa.array([], f.type) for f in _FOUND], fields=list(_FOUND))


def _hash(k: int) -> Column:
    """The k-th group of 8 digits of the document's hash, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


# -------------------------------------------------------------------------------------------------- long documents


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            raw = one.column("text")[0].as_py().encode()
            for at in range(0, len(raw), CHUNK * 64):
                parts = [raw[x : x + CHUNK] for x in range(at, min(at + CHUNK * 64, len(raw)), CHUNK)]
                same = [pa.array(one.column(c).to_pylist() * len(parts), pa.int64()) for c in ("d_shard", "d_place", "a", "b")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(at // CHUNK, at // CHUNK + len(parts))), pa.array(parts, pa.binary())], names=["d_shard", "d_place", "a", "b", "k", "data"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's function and counts by start state."""
    for batch in batches:
        raw = batch.column("data").to_pylist()
        for x in _blocks(raw):
            f = Scan(raw[x]).fold
            rows = batch.slice(x.start, x.stop - x.start)
            lists = [pa.array(list(y.astype(np.int64)), pa.list_(pa.int64())) for y in (f.after, f.ends, f.marks)]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in (SHARD, PLACE, "d_shard", "d_place", "a", "b", "k")], *lists, pa.array(f.chars)], names=[SHARD, PLACE, "d_shard", "d_place", "a", "b", "k", "after", "ends", "marks", "chars"])


_PIECE = "struct<shard:long,place:long,entry:long,k1:long,k2:long,chars:long>"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their chunks in order: units, cuts that need no chunk, and the chunks that hold a cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("pieces")
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        number = lambda c, flat=flat: flat.field(c).to_numpy()
        table = lambda c, flat=flat: flat.field(c).flatten().to_numpy().reshape(-1, STATES)
        f = fold(table("after"), table("ends"), table("marks"), number("chars"), sizes)
        n, cut = _units(f.ends[:, SPACE], f.chars, batch.column("a").to_numpy(), batch.column("b").to_numpy())
        own = np.take_along_axis(table("ends"), f.entry, 1)[:, SPACE]
        before = f.upto[:, SPACE] - own
        before = before - np.repeat(before[np.cumsum(sizes) - sizes], sizes)
        rest = [np.where(u > f.ends[:, SPACE], f.chars, 0) for u in cut]
        k = [np.repeat(u, sizes) - before for u in cut]
        k = [np.where((x > 0) & (x <= own), x, 0) for x in k]
        hit = np.flatnonzero((k[0] > 0) | (k[1] > 0))
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        piece = pa.StructArray.from_arrays([pa.array(x[hit].astype(np.int64)) for x in (number("shard"), number("place"), f.entry[:, SPACE], k[0], k[1], f.chars_before)], names=["shard", "place", "entry", "k1", "k2", "chars"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("d_shard"), batch.column("d_place"), pa.array(n), pa.array(rest[0]), pa.array(rest[1]), pa.array((f.marks[:, SPACE] > 0).astype(np.int64)), pa.ListArray.from_arrays(offsets, piece)],
            names=["d_shard", "d_place", "n", "first", "second", "marked", "pieces"],
        )


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the chunks that hold a cut, the code points before it, counted from the document's start."""
    for batch in batches:
        raw = batch.column("data").to_pylist()
        for x in _blocks(raw):
            rows = batch.slice(x.start, x.stop - x.start)
            scan, number = Scan(raw[x]), lambda c, rows=rows: rows.column(c).to_numpy()
            at = []
            for c in ("k1", "k2"):
                has = np.flatnonzero(number(c) > 0)
                where = np.zeros(rows.num_rows, np.int64)
                where[has] = scan.chars_to(has, number("entry")[has], number(c)[has]) + number("before")[has]
                at.append(pa.array(where))
            yield pa.RecordBatch.from_arrays([rows.column("d_shard"), rows.column("d_place"), *at], names=["d_shard", "d_place", "first", "second"])


def _long(docs: DataFrame) -> DataFrame:
    """The documents of more than CHUNK bytes with n, first, second, marked."""
    base = spool_rows(docs.withColumns({"a": _hash(1), "b": _hash(2)}))
    told = base.select(F.col(SHARD).alias("d_shard"), F.col(PLACE).alias("d_place"), "a", "b", "text")
    chunks = spool_rows(told.mapInArrow(_chunks, "d_shard long, d_place long, a long, b long, k long, data binary"))
    lists = "after array<long>, ends array<long>, marks array<long>"
    pieces = chunks.mapInArrow(_summaries, f"{SHARD} long, {PLACE} long, d_shard long, d_place long, a long, b long, k long, {lists}, chars long")
    pieces = pieces.groupBy("d_shard", "d_place", "a", "b").agg(F.sort_array(F.collect_list(F.struct("k", F.col(SHARD).alias("shard"), F.col(PLACE).alias("place"), "after", "ends", "marks", "chars"))).alias("pieces"))
    units = spool(pieces.mapInArrow(_composed, f"d_shard long, d_place long, n long, first long, second long, marked long, pieces array<{_PIECE}>"))
    chosen = units.select(F.inline("pieces")).select(F.col("shard").alias(SHARD), F.col("place").alias(PLACE), "entry", "k1", "k2", F.col("chars").alias("before"))
    cuts = at_places(chunks, chosen, entry="long", k1="long", k2="long", before="long").mapInArrow(_selected, "d_shard long, d_place long, first long, second long")
    cuts = units.select("d_shard", "d_place", "first", "second", "n", "marked").unionByName(cuts, allowMissingColumns=True)
    cuts = cuts.groupBy(F.col("d_shard").alias(SHARD), F.col("d_place").alias(PLACE)).agg(*[F.max(c).alias(c) for c in ("first", "second", "n", "marked")])
    return at_places(base, cuts, n="long", first="long", second="long", marked="long").select("doc_id", "text", "n", "first", "second", (F.col("marked") > 0).alias("marked"))


# ---------------------------------------------------------------------------------------------------------- outputs


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form: a text with markers is plain, so the first markers are ours."""
    p, s, m = (F.locate(x, output) for x in ("<P>", "<S>", "<M>"))
    between = lambda start, stop: F.substring(output, start + 3, stop - start - 3)
    rest = F.substring(output, m + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), rest, between(s, m))).otherwise(F.concat(between(p, m), rest, between(s, p)))


def transformed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output (the text as it is trained on)."""
    small_batches(docs.sparkSession)
    source = only(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    short = source.where(F.octet_length("text") <= CHUNK).withColumn("found", F.arrow_udf(_short, _FOUND_DDL)("text", _hash(1), _hash(2))).select("doc_id", "text", "found.*")
    rows = short.unionByName(_long(source.where(F.octet_length("text") > CHUNK)))
    form = F.when((F.col("text") == "") | F.col("marked") | (_hash(3) % 100 >= RATE), "plain").when(_hash(4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    part = lambda start, size: F.substring(F.col("text"), (start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("first")), part(F.col("first"), F.col("second") - F.col("first")), part(F.col("second"), F.length("text"))
    mark = F.lit
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(mark("<P>"), prefix, mark("<S>"), suffix, mark("<M>"), middle)).otherwise(F.concat(mark("<S>"), suffix, mark("<P>"), prefix, mark("<M>"), middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def digests(docs: DataFrame) -> DataFrame:
    """``transformed`` with hashes of the outputs, and of what is rebuilt from them, in the outputs' place."""
    found = transformed(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
