"""Likeness of short strings.  There are no built-ins for these, so they are Arrow-batched Pandas UDFs: call them on
blocked pairs and on distinct words only."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel_ratio(one, two), *((indel_ratio(both, one), indel_ratio(both, two)) if both else (0.0, 0.0)))


def partial(a: str, b: str) -> float:
    """The shorter string against every piece of the longer one of its length, ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 1.0
    n = len(short)
    if n < 64:
        return _partial_bits(short, long)
    pieces = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, p) for p in pieces)


def _partial_bits(short: str, long: str) -> float:
    """All pieces at once, by bit-parallel rows of a word each; beyond the ends is nothing that matches."""
    n, codes = len(short), np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    masks = np.zeros(len(codes) + 2 * (n - 1), np.uint64)
    of_long = masks[n - 1 : n - 1 + len(codes)]
    for c in set(short):
        of_long[codes == ord(c)] = sum(1 << i for i, x in enumerate(short) if x == c)
    pieces = len(codes) + n - 1
    full = np.uint64((1 << n) - 1)
    row = np.full(pieces, full)
    for i in range(n):
        hit = row & masks[i : i + pieces]
        row = ((row + hit) | (row - hit)) & full
    at = np.arange(1 - n, len(codes))
    sizes = np.minimum(at + n, len(codes)) - np.maximum(at, 0)
    return float((2 * (n - np.bitwise_count(row).astype(np.int64)) / (n + sizes)).max())


def jaro_winkler_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for j, c in enumerate(b) if not free[j]]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _pairwise(measure):
    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return udf


token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler = map(_pairwise, (token_sort, token_set, partial, jaro_winkler_of))
sequence_ratio = _pairwise(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())


def close_typo(a, b, least: float = 0.78, most_apart: int = 4):
    """Sequence likeness of at least ``least`` between strings of about one length."""
    return (F.abs(F.length(a) - F.length(b)) <= most_apart) & (sequence_ratio(a, b) >= least)


def canonical_words(tokens, variants, least: float = 0.92):
    """Distinct tokens (word) with their canonical form: exact variants, else the closest of a word of five or more.

    ``variants`` is a dictionary (variant, canonical) of bounded size.  With the largest bonus for a common beginning the
    measure reaches ``least`` only if the shorter length is ``band`` of the longer one: words meet variants by length.
    """
    band = max(0.0, 3 * (least - 0.4) / 0.6 - 2)
    exact = tokens.join(variants, tokens["word"] == variants["variant"], "left").select("word", "canonical")
    n = F.length("word")
    fits = F.sequence(F.ceil(n * band).cast("int"), F.floor(n / F.lit(band)).cast("int") if band else n + 40)
    rest = exact.where("canonical is null and length(word) >= 5").select("word", F.explode(fits).alias("_n"))
    near = rest.join(variants.withColumn("_n", F.length("variant")), "_n").withColumn("_s", jaro_winkler("word", "variant")).where(F.col("_s") >= least)
    near = near.groupBy("word").agg(F.max_by("canonical", F.struct("_s", "canonical")).alias("_near"))
    return exact.join(near, "word", "left").select("word", F.coalesce("canonical", "_near", "word").alias("canonical"))


def split_compounds(words, lexicon: set[str], least: int = 3, most: int = 3):
    """A column of distinct words cut to lexicon words, greedily the longest first; what is left stays a part."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def udf(words: pd.Series) -> pd.Series:
        def one(word: str) -> list[str]:
            if word is None or len(word) < 7 or word in lexicon:
                return [word]
            parts, rest = [], word
            while rest and len(parts) < most:
                cut = next((rest[:n] for n in range(len(rest), least - 1, -1) if rest[:n] in lexicon), None)
                if cut is None:
                    break
                parts.append(cut)
                rest = rest[len(cut) :]
            return parts + ([rest] if rest else []) if parts else [word]

        return words.map(one)

    return udf(words)
