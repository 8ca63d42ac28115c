"""Strings of two tables held against each other in packs, where nothing that is cheap to join by tells them apart.

Segments and shared words do little for strings that are made of the same few words, or where a low likeness leaves segments of
two letters: nearly all pairs meet, and each is a row to shuffle.  Here packs of some thousand strings meet, each two once, in
as many tasks as there are such pairs; a bound is computed of all their pairs at once, the measure of what passes it, and only
results leave the task.

Typos go further: entries of a pack are a tree of their letters, and all keywords walk down it together, letter by letter.  A
keyword leaves a branch as soon as what it has matched, and all that can follow, is too little for every entry there; so what
is compared is beginnings, of which entries that are made of the same words have few.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.functions.fuzzy import token_set
from cartoflow.store.shared import spool

PACK, STRIP, TASKS = 8192, 1024, 4096
#: Letters of a keyword that a word of bits holds, with one for the carry.
LETTERS = 63
#: Likenesses that the best entry is looked for in turn.
STEPS = (0.95,)
#: Entries and keywords of packs of typos, pairs of keyword and beginning that walk at once, and candidates kept unmeasured.
ENTRIES, KEYWORDS, FRONT, KEPT = 1 << 17, 1 << 16, 1 << 18, 1 << 20
#: Words of bits of the letters of keywords, at most.
BITS = 1 << 23

_FOUND = "a string, b string, likeness double"


def _packed(strings: DataFrame, c: str, size: int) -> tuple[DataFrame, int]:
    """(pack, strings), neighbours in order together, and how many packs at most; a pack's strings ascend."""
    strings = spool(strings.select(c).where(F.col(c).isNotNull()).distinct())
    n = max(1, -(-strings.count() // size))
    packs = strings.repartitionByRange(n, c).groupBy(F.spark_partition_id().alias("pack")).agg(F.sort_array(F.collect_list(c)).alias(c))
    return spool(packs), n


def compared(left: DataFrame, right: DataFrame, measured: Callable[[list[str], list[str]], Iterator[tuple[str, str, float]]], sizes: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, likeness): what ``measured`` finds in each pack of the column ``a`` and pack of the column ``b``."""
    (a, na), (b, nb) = (_packed(df, c, size) for df, c, size in zip((left, right), "ab", sizes or (PACK, PACK), strict=True))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(TASKS, na * nb)
    a = a.select(F.col("pack").alias("pack_a"), "a", number(nb).alias("pack_b")).repartition(tasks, "pack_a", "pack_b")
    b = b.select(F.col("pack").alias("pack_b"), "b", number(na).alias("pack_a")).repartition(tasks, "pack_a", "pack_b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                found = list(measured(x.as_py(), y.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "likeness"])

    return spool(a.join(b, ["pack_a", "pack_b"]).select("a", "b").mapInArrow(each, _FOUND))


# ------------------------------------------------------------------------------------------------------- token sets


def _lines(names: list[str]) -> list[str]:
    return [" ".join(sorted(set(x.split()))) for x in names]


def _letters(lines: list[str], columns: dict[tuple[str, int], int], grow: bool) -> np.ndarray:
    """A row a line: which letters it has once, twice, and so on, by ``columns``."""
    rows, at = [], []
    for i, line in enumerate(lines):
        seen: dict[str, int] = {}
        for c in line:
            seen[c] = seen.get(c, 0) + 1
            j = columns.setdefault((c, seen[c]), len(columns)) if grow else columns.get((c, seen[c]))
            if j is not None:
                rows.append(i)
                at.append(j)
    cells = np.zeros((len(lines), len(columns)), np.float32)
    cells[rows, at] = 1
    return cells


def token_sets(least: float) -> Callable[[list[str], list[str]], Iterator[tuple[str, str, float]]]:
    """Pairs whose matched letters can be enough, whatever their order: the letters that both have."""

    def measured(a: list[str], b: list[str]) -> Iterator[tuple[str, str, float]]:
        one, two = _lines(a), _lines(b)
        columns: dict[tuple[str, int], int] = {}
        left = _letters(one, columns, True)
        right = _letters(two, columns, False).T
        n = np.array([len(x) for x in two], np.float32)
        for lo in range(0, len(a), STRIP):
            both = left[lo : lo + STRIP] @ right
            for i, row in enumerate(both):
                for j in np.flatnonzero(row >= (len(one[lo + i]) + n) * np.float32(least / 2) - np.float32(1e-3)).tolist():
                    likeness = token_set(a[lo + i], b[j])
                    if likeness >= least - 1e-9:
                        yield a[lo + i], b[j], likeness

    return measured


# ------------------------------------------------------------------------------------------------------------ typos


class _Tree:
    """The beginnings of ascending distinct strings, by length: groups of strings that share one, with the last letter (0
    where a string has ended before), the least and the greatest length, and the groups that continue them."""

    def __init__(self, entries: list[str]):
        self.sizes = np.array([len(x) for x in entries], np.int64)
        letters, codes = np.unique(_codes(entries), return_inverse=True)
        self.letters = letters
        self.cells = np.zeros((len(entries), int(self.sizes.max()) + 1), np.uint16 if len(letters) < 65535 else np.uint32)
        self.cells[np.arange(self.cells.shape[1]) < self.sizes[:, None]] = codes + 1
        self.shared = np.full(len(entries), -1)
        self.shared[1:] = (self.cells[1:] != self.cells[:-1]).argmax(1)
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}

    def starts(self, depth: int) -> np.ndarray:
        return np.flatnonzero(self.shared < depth)

    def level(self, depth: int) -> tuple[np.ndarray, ...]:
        """Of the groups that share ``depth`` letters: first string, last letter, lengths, first group behind and how many."""
        if depth not in self.levels:
            at = self.starts(depth)
            behind = np.searchsorted(self.starts(depth + 1), at)
            many = np.diff(behind, append=len(self.starts(depth + 1)))
            letter = self.cells[at, depth - 1] if depth else np.zeros(1, np.uint16)
            self.levels[depth] = (at, letter, np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at), behind, many)
        return self.levels[depth]


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def _lengths(n: np.ndarray, least: float, apart: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest length of what may be so like strings of these lengths."""
    lo, hi = np.ceil(n * (least / (2 - least)) - 1e-9).astype(np.int64), np.floor(n * ((2 - least) / least) + 1e-9).astype(np.int64)
    return (lo, hi) if apart is None else (np.maximum(lo, n - apart), np.minimum(hi, n + apart))


def _walked(keywords: list[str], tree: _Tree, half: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keywords, entries and the length of their longest common subsequence, where it is at least ``half`` (of the keyword,
    looked at anew in each step) of both lengths.

    Rows of bits are those of the bit-parallel subsequence: its zeros among the first i bits are what the first i letters of a
    keyword have in common with a beginning.
    """
    size, (shortest, longest) = np.array([len(x) for x in keywords], np.int64), lengths
    ones = np.array([(1 << i) - 1 for i in range(LETTERS + 1)], np.uint64)
    full = ones[size]
    masks = np.zeros((len(tree.letters) + 1, len(keywords)), np.uint64)
    codes = _codes(keywords)
    place = np.minimum(np.searchsorted(tree.letters, codes), len(tree.letters) - 1)
    known = tree.letters[place] == codes
    of = np.repeat(np.arange(len(keywords)), size)
    bit = np.uint64(1) << (np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    np.bitwise_or.at(masks, (place[known] + 1, of[known]), bit[known])

    stack = [(0, np.arange(len(keywords)), np.zeros(len(keywords), np.int64), full)]
    while stack:
        depth, k, group, row = stack.pop()
        *_, behind, many = tree.level(depth)
        n = many[group]
        ends = np.cumsum(n)
        if ends[-1] > FRONT and len(k) > 1:
            cut = min(max(int(np.searchsorted(ends, ends[-1] // 2)), 1), len(k) - 1)
            stack += [(depth, k[cut:], group[cut:], row[cut:]), (depth, k[:cut], group[:cut], row[:cut])]
            continue
        group = np.repeat(behind[group] - (ends - n), n) + np.arange(ends[-1])
        k, row = np.repeat(k, n), np.repeat(row, n)
        first, letter, low, high, *_ = tree.level(depth + 1)
        letter = letter[group]
        hit = row & masks[letter, k]
        row = ((row + hit) | (row - hit)) & full[k]
        la = size[k]
        matched = la - np.bitwise_count(row)
        ended = letter == 0
        if ended.any():
            good = ended & (matched >= half[k] * (la + depth) - 1e-9) & (depth >= shortest[k]) & (depth <= longest[k])
            if good.any():
                yield k[good], first[group[good]], matched[good]
        depth += 1
        # What follows has least .. most letters; more of them than the keyword has left are no use.
        least, most = np.maximum(low[group], shortest[k]) - depth, np.minimum(high[group], longest[k]) - depth
        more = np.minimum(np.maximum(la - matched, least), most)
        open_ = np.flatnonzero(~ended & (least <= most) & (np.minimum(matched + more, la) >= half[k] * (la + depth + more) - 1e-9))
        k, group, row, la, least, most = (x[open_] for x in (k, group, row, la, least, most))
        # Of a keyword, what follows can match the last letters only, as many as it has.
        head = np.maximum(la - most, 0)
        reach = head - np.bitwise_count(row & ones[head]) + np.minimum(most, la)
        open_ = np.flatnonzero(reach >= half[k] * (la + depth + least) - 1e-9)
        if len(open_):
            stack.append((depth, k[open_], group[open_], row[open_]))


def best_typos(least: float, apart: int | None) -> Callable[[list[str], list[str]], Iterator[tuple[str, str, float]]]:
    """Of each keyword the most like entry of the pack, the greatest of equals: entries are measured in the order of what they
    can reach, until the best measured one is out of reach."""

    def near(keywords: list[str], entries: list[str], tree: _Tree) -> Iterator[tuple[str, str, float]]:
        size = np.array([len(k) for k in keywords], np.int64)
        half, best, kept = np.full(len(keywords), least / 2), {}, []

        def measure() -> None:
            k, e, matched = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            reach = 2 * matched / (size[k] + tree.sizes[e])
            for i in np.lexsort((-e, -reach, k)).tolist():
                at, entry = int(k[i]), entries[e[i]]
                old = best.get(at, (least, ""))
                if reach[i] >= old[0] - 1e-12:
                    best[at] = max(old, (difflib.SequenceMatcher(None, keywords[at], entry).ratio(), entry))
            for at, (likeness, _) in best.items():
                half[at] = likeness / 2

        for found in _walked(keywords, tree, half, _lengths(size, least, apart)):
            kept.append(found)
            if sum(len(x[0]) for x in kept) >= KEPT:
                measure()
        if kept:
            measure()
        yield from ((keywords[at], entry, likeness) for at, (likeness, entry) in best.items() if entry)

    def measured(keywords: list[str], entries: list[str]) -> Iterator[tuple[str, str, float]]:
        sizes = np.unique([len(e) for e in entries])
        lo, hi = _lengths(np.arange(LETTERS + 1), least, apart)
        fits = {n for n in range(1, LETTERS + 1) if ((sizes >= lo[n]) & (sizes <= hi[n])).any()}
        keywords = [k for k in keywords if len(k) in fits]
        keep = (min(lo[n] for n in fits), max(hi[n] for n in fits)) if fits else (0, 0)
        entries = [e for e in entries if keep[0] <= len(e) <= keep[1] and e]
        if not keywords or not entries:
            return
        tree = _Tree(entries)
        step = max(1, BITS // (len(tree.letters) + 1))
        for at in range(0, len(keywords), step):
            yield from near(keywords[at : at + step], entries, tree)

    return measured


def best_entries(keywords: DataFrame, entries: DataFrame, least: float, apart: int | None) -> DataFrame:
    """(a, b, likeness): of keywords ``a`` the best entry of ``b`` that is at least so like, a row for each pack that has one.
    High likenesses are asked for first, as few entries reach them; a keyword that has one there needs no other."""
    rest = keywords.select("a").where(F.length("a").between(1, LETTERS))
    # Lengths of keywords are few, and those of entries that may be like one are too.
    lo, hi = _lengths(np.arange(LETTERS + 1), least, apart)
    asked = [x[0] for x in rest.select(F.length("a")).distinct().collect()]
    known = {int(n) for x in asked for n in range(int(lo[x]), int(hi[x]) + 1)}
    entries = entries.select("b").where(F.length("b").isin(sorted(known)) if known else F.lit(False))
    sizes = {x[0] for x in entries.select(F.length("b")).distinct().collect()}
    fits = [x for x in asked if any(lo[x] <= n <= hi[x] for n in sizes)]
    found, rest = [], rest.where(F.length("a").isin(fits) if fits else F.lit(False))
    for step in [x for x in STEPS if x > least] + [least]:
        found.append(compared(rest, entries, best_typos(step, apart), (KEYWORDS, ENTRIES)))
        rest = rest.join(found[-1].select("a"), "a", "left_anti")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
