"""What the operators share: the shared folder, spooled tables, and vectorised work on blocks of text.

Python stages get Arrow batches and cut them to blocks of a few MB of text (``blocks``), so a worker's memory does
not depend on how many rows a batch has; only one very long text can make a block larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflow.store.shared import shared_dir, spool  # noqa: F401

#: Text bytes of a block; numpy temporaries take some tens of bytes for each.
BLOCK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, when the session does not say.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and of bounded bytes, unless the session has numbers of its own: texts can be long."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", str(BATCH_BYTES))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: other columns, whatever they are called, cannot clash from here on."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def hashed_sample(df: DataFrame, key: list[str], n: int, total: int) -> DataFrame:
    """The ``n`` rows of least hash of the key, of ``total``: a filter by hash leaves about twice as many, which alone are
    ordered; so what meets in one task does not grow with the table."""
    h = F.xxhash64(*key)
    if total > 4 * n:
        df = df.where(F.shiftrightunsigned(h, 1) < F.lit(min((1 << 63) - 1, (1 << 63) * (2 * n + 100) // total)))
    return df.orderBy(h, *key).limit(n)


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but the used ones under names that clash with nothing, and what gives the names back."""
    names = {c: c if c in used else f"__other_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), lambda out: out.select(*[F.col(safe).alias(c) for c, safe in names.items()], *[c for c in out.columns if c not in names.values()])


# ---------------------------------------------------------------------------------------------------- text blocks


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, "Block"]]:
    """Slices of the batches with at most ``limit`` text bytes (one row at least), with their texts as a Block."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(text))
        values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
        raw = [b"" if x is None else x for x in values.to_pylist()]
        at = held = 0
        for i, value in enumerate(raw):
            if i > at and held + len(value) > limit:
                yield batch.slice(at, i - at), Block(raw[at:i])
                at, held = i, 0
            held += len(value) + 1
        yield batch.slice(at), Block(raw[at:])


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Of 256 booleans, those within the ranges are true."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each; grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some texts as one byte array, a line feed after each; offsets count in that array."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.starts = self.ends - self.lengths
        self.n = len(raw)

    def lower(self) -> np.ndarray:
        return LOWER[self.data]

    def words(self, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (exclusive) and texts of the words; a word never crosses texts, as line feeds are in none."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = table[data]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.searchsorted(self.ends, starts)

    def per_text(self, owners: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        if weights is None:
            return np.bincount(owners, minlength=self.n).astype(np.int64)
        return np.rint(np.bincount(owners, weights=weights, minlength=self.n)).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: equal spans have equal hashes, wherever they are."""
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` values (by its first value's index); there are len - k + 1."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + values[j : j + n]
    return mixed(out)


def sliding(values: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over each window of ``w`` values, by doubling; there are len - w + 1."""
    have, out = 1, values
    while have < w:
        step = min(have, w - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def grouped_rank(owners: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal owners (owners ascend)."""
    if not len(owners):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    return np.arange(len(owners)) - np.repeat(first, np.diff(np.append(first, len(owners))))
