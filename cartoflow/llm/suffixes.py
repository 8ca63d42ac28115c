r"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if some string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or before in the
same document.  Documents are cut to shards of a few MB, fixed when they are spooled.

1. Anchors.  Every window of LENGTH bytes has the least hash of its GRAM-byte grams as anchor; equal windows have equal
   anchors, and only about one gram in 35 is one.  Anchors that occur twice or more, in one shard or in several, say
   which windows can repeat; all others are left alone from here on.
2. Suffix arrays.  Each shard sorts the suffixes at windows whose anchor it has twice: ranks by 8 bytes, doubled on
   groups that are not yet single (Larsson and Sadakane) to 64, then to LENGTH; common prefixes of neighbours by Kasai's
   recurrence.  Of equal windows the first stays; only it goes on, and only if its anchor is in another shard too.
3. Merging.  What goes on are pieces: the windows in a row that have one anchor.  Pieces meet by anchor; equal ones, by a
   128-bit digest of their bytes, are settled at once, as within a copied passage all are.  The others, at the passages'
   edges, bring their bytes: each shard's windows are a sorted run, runs are merged in pairs by binary search, and of
   equal windows the owner that comes first stays.  So a passage that a third of all documents share sends one piece a
   shard, however many copies there are.  Where such a passage ends, every document goes on in its own way, with the
   passage's anchor: pieces at an anchor of more than HOT places are not merged in one task but dealt, window by window, by
   the digest of the window, which settles them.

No text is shuffled; what is decided about a shard comes back to it as rows addressed by shard and document.

Cases.  Null or empty text: no bytes.  Repeated rows: all but one are later copies.  Equal doc_ids with other texts come
in the order of the texts' hashes; null ids come last.  Empty table: empty result.  Other columns are ignored by
``removal`` and kept by ``cleaned``, which gives texts back without cut characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import Block, blocks, mixed, only, power_tables, set_aside, shared_dir, sliding, spool
from cartoflow.llm.shards import PLACE, SHARD, spool_shards, summaries, with_side, write_side

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
SHARD_BYTES = 2 << 20
_FILTER_BITS = 21
#: Bytes of first windows that are merged at a time (a hundred times as many are compared).
CHUNK = 1 << 20
#: Places of an anchor that are merged in one task, at most.
HOT = 1024

_H, _SHARD, _D = "__text_hash", SHARD, PLACE


# ------------------------------------------------------------------------------------------------ windows, anchors


def _grams(data: np.ndarray) -> np.ndarray:
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])


def _windows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the grams, the anchor of the window at each offset, and whether the window lies within one text."""
    if len(block.data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = _grams(block.data)
    anchors = sliding(grams, WINDOW)
    edges = np.zeros(len(block.data) + 1, np.int32)
    long = block.lengths >= LENGTH
    edges[block.starts[long]] += 1
    edges[block.ends[long] - LENGTH + 1] -= 1
    return grams, anchors, np.cumsum(edges)[: len(anchors)] > 0


def _anchor_places(grams: np.ndarray, anchors: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The grams that are the anchor of a window, each place once."""
    pad = np.zeros(WINDOW - 1, np.uint64)
    return grams[sliding(np.concatenate([pad, np.where(valid, anchors, np.uint64(0)), pad]), WINDOW, np.maximum) == grams]


# ---------------------------------------------------------------------------------------------------- suffix array


def _refined(order: np.ndarray, rank: np.ndarray, h: int) -> None:
    """One doubling, in place: groups of equal h-byte prefixes, unless single, are sorted by the rank h further on."""
    n = len(order)
    head = np.ones(n + 1, bool)
    by = rank[order]
    head[1:n] = by[1:] != by[:-1]
    slots = np.flatnonzero(~(head[:-1] & head[1:]))  # of groups with two or more
    if not len(slots):
        return
    at = order[slots]
    key = (by[slots].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n - 1)].astype(np.uint64)
    sub = np.argsort(key)
    at, key = at[sub], key[sub]
    order[slots] = at
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]


def suffix_order(text: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The positions ``at`` sorted by the ``length`` (over 64, up to 128) bytes there; all of them within ``text``."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(first)
    by = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], by[1:] != by[:-1]]), np.arange(n), 0))
    del first, by
    for h in (8, 16, 32):
        _refined(order, rank, h)
    key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + length - 64].astype(np.uint64)
    return at[np.argsort(key, kind="stable")]


def common_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it (0 for the first), by Kasai's recurrence.

    Where a suffix and its predecessor both follow, in the text, another such pair, they share one byte less than that
    pair; only the others are compared.
    """
    n, m = len(text), len(suffixes)
    if m < 2:
        return np.zeros(m, np.int64)
    before = np.full(n + 1, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    i = np.flatnonzero(before[:-1] >= 0)
    j = before[i]
    follows = np.zeros(len(i), bool)
    follows[1:] = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)
    heads = np.flatnonzero(~follows)
    a, b = i[heads], j[heads]
    shared = np.zeros(len(heads), np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), ">u8", padded, strides=(1,))
    live = np.arange(len(heads))
    for _ in range(40):
        if not len(live):
            break
        x, y = a[live] + shared[live], b[live] + shared[live]
        room = n - np.maximum(x, y)
        diff = words[x].astype(np.uint64) ^ words[y].astype(np.uint64)
        same = np.where(diff == 0, 8, 0)
        odd = np.flatnonzero(diff)
        for k in range(7):
            same[odd] += (diff[odd] >> np.uint64(56 - 8 * k)) == 0
        shared[live] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8)]
    for k in live.tolist():  # few and long
        x, y = int(a[k] + shared[k]), int(b[k] + shared[k])
        while max(x, y) < n:
            step = min(1 << 16, n - max(x, y))
            odd = np.flatnonzero(text[x : x + step] != text[y : y + step])
            if len(odd):
                x += int(odd[0])
                break
            x, y = x + step, y + step
        shared[k] = x - a[k]
    run = np.cumsum(~follows) - 1
    plcp = np.zeros(n, np.int64)
    plcp[i] = shared[run] - (i - a[run])
    return plcp[suffixes]


def first_of_equal(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows sorted, and for each the least position of an equal one."""
    suffixes = suffix_order(text, at)
    heads = np.flatnonzero(common_prefixes(text, suffixes) < LENGTH)
    return suffixes, np.repeat(np.minimum.reduceat(suffixes, heads), np.diff(np.append(heads, len(suffixes))))


# ------------------------------------------------------------------------------------------------------ the shards


def _spooled(docs: DataFrame) -> DataFrame:
    """The documents in shards; a shard's summary is its anchors and how often they are."""

    def close(found: list) -> pa.StructArray:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    kind = pa.struct([("h", pa.int64()), ("n", pa.int64())])
    return spool_shards(docs.withColumn(_H, F.xxhash64("text")), kind, "struct<h:long,n:long>", lambda found, rows, block: found.append(_anchor_places(*_windows(block))), close, SHARD_BYTES)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i] .. starts[i] + lengths[i] - 1."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum())


def _candidate_text(rows: list[pa.RecordBatch], side: dict[str, np.ndarray]):
    """The pieces of a shard's texts that candidate windows cover, in document order.

    Returns the text, and for each of its bytes: document place, offset there, whether a window starts here, the
    window's anchor, whether other shards have the anchor, whether this one has it again, and whether it is hot.
    """
    known, crossed, again, hot = side["h"].view(np.uint64), side["crossed"], side["again"], side["hot"]
    order = np.argsort(known)
    known, crossed, again, hot = known[order], crossed[order], again[order], hot[order]
    table = np.zeros(1 << _FILTER_BITS, bool)
    low = np.uint64((1 << _FILTER_BITS) - 1)
    table[(known & low).astype(np.int64)] = True
    pieces = []
    for sub, block in blocks(iter(rows), "text"):
        place = sub.column(sub.schema.get_field_index(_D)).to_numpy()
        _, anchors, valid = _windows(block)
        at = np.flatnonzero(valid & table[(anchors & low).astype(np.int64)])
        if not len(at):
            continue
        hit = np.minimum(np.searchsorted(known, anchors[at]), len(known) - 1)
        good = known[hit] == anchors[at]
        at, hit = at[good], hit[good]
        edges = np.zeros(len(block.data) + 1, np.int32)
        edges[at] += 1
        edges[at + LENGTH] -= 1
        keep = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
        starts, over, twice, often = (np.zeros(len(block.data), bool) for _ in range(4))
        starts[at], over[at], twice[at], often[at] = True, crossed[hit], again[hit], hot[hit]
        text = np.searchsorted(block.ends, keep)
        anchor = np.zeros(len(block.data), np.uint64)
        anchor[at] = anchors[at]
        pieces.append((block.data[keep], place[text], keep - block.starts[text], starts[keep], anchor[keep], over[keep], twice[keep], often[keep]))
    return [np.concatenate(x) for x in zip(*pieces, strict=True)] if pieces else None


def _ranks(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Order of ids of any type; nulls last."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _ordered(rows: list[pa.RecordBatch]) -> np.ndarray:
    """Rank of each place of a shard: by doc_id (nulls last), then hash of the text, then place."""
    ids = _ranks(pa.chunked_array([x.column(x.schema.get_field_index("doc_id")) for x in rows]))
    hashes = np.concatenate([x.column(x.schema.get_field_index(_H)).to_numpy() for x in rows])
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((hashes, ids))] = np.arange(len(ids))
    return rank


def _first(kind: pa.DataType) -> pa.Schema:
    """Rows of pieces; a range to remove has no h."""
    return pa.schema([("h", pa.int64()), (_SHARD, pa.int64()), (_D, pa.int64()), ("doc_id", kind), (_H, pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("hot", pa.bool_()), ("digest", pa.binary()), ("bytes", pa.binary())])


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def _sorted_shard(shard: int, rows: list[pa.RecordBatch], side: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Removed ranges of a shard by itself (h null), and its first windows whose anchors other shards have."""
    got = _candidate_text(rows, side) if side else None
    if got is None:
        return None
    of = _ordered(rows)[got[1]]
    if (of[1:] < of[:-1]).any():  # whole documents change places
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        lengths = np.diff(np.append(heads, len(of)))
        by = np.argsort(of[heads])
        got = [x[_spread(heads[by], lengths[by])] for x in got]
    text, place, offset, starts, anchor, over, twice, hot = got
    repeated = np.zeros(len(text), bool)
    if twice.any():
        edges = np.zeros(len(text) + LENGTH, np.int32)
        edges[:-LENGTH] += twice
        edges[LENGTH:] -= twice
        kept = np.flatnonzero(np.cumsum(edges)[: len(text)] > 0)
        suffixes, first = first_of_equal(text[kept], np.flatnonzero(twice[kept]))
        repeated[kept[suffixes[first != suffixes]]] = True
    going = starts & over & ~repeated
    new = np.ones(len(text), bool)  # a piece, document or anchor begins
    new[1:] = (place[1:] != place[:-1]) | (offset[1:] != offset[:-1] + 1)

    def cut(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the mask that no break interrupts."""
        begin = mask & (breaks | ~np.concatenate([[False], mask[:-1]]))
        begins = np.flatnonzero(begin)
        end = mask & ~np.concatenate([mask[1:] & ~breaks[1:], [False]])
        return begins, np.flatnonzero(end) + 1

    a, b = cut(repeated, new)
    ids = pa.chunked_array([x.column(x.schema.get_field_index("doc_id")) for x in rows]).combine_chunks()
    local = [pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), shard)), pa.array(place[a]), pa.nulls(len(a), ids.type), pa.nulls(len(a), pa.int64()), pa.array(offset[a]), pa.array(offset[b - 1] + LENGTH), pa.nulls(len(a), pa.bool_()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.binary())]
    changed = new.copy()
    changed[1:] |= anchor[1:] != anchor[:-1]
    a, b = cut(going, changed)
    n = b - a
    hashes = np.concatenate([x.column(x.schema.get_field_index(_H)).to_numpy() for x in rows])
    grown = n + LENGTH - 1
    offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
    ends = np.cumsum(grown)
    raw = text[_spread(a, grown)].tobytes()
    digests = _digests(raw, ends - grown, ends)
    data = pa.Array.from_buffers(pa.binary(), len(a), [None, offsets(grown).buffers()[1], pa.py_buffer(raw)])
    away = [pa.array(anchor[a].view(np.int64)), pa.array(np.full(len(a), shard)), pa.array(place[a]), ids.take(pa.array(place[a])), pa.array(hashes[place[a]]), pa.array(offset[a]), pa.array(offset[b - 1] + LENGTH), pa.array(hot[a]), digests, data]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(local, away, strict=True)], schema=_first(ids.type))


# ----------------------------------------------------------------------------------------------------- the merging


def merged(runs: list[tuple[np.ndarray, np.ndarray]], lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs (keys, owners) in pairs by binary search; owners that lose to a smaller one of an equal key are
    marked in ``lost``."""
    while len(runs) > 1:
        left = []
        for (a, p), (b, q) in zip(runs[::2], runs[1::2], strict=False):
            if len(a) < len(b):
                a, p, b, q = b, q, a, p
            at = np.searchsorted(a, b)
            near = np.minimum(at, len(a) - 1)
            equal = (at < len(a)) & (a[near] == b)
            lost[np.maximum(p[near[equal]], q[equal])] = True
            p = p.copy()
            p[near[equal]] = np.minimum(p[near[equal]], q[equal])
            left.append((np.insert(a, at[~equal], b[~equal]), np.insert(p, at[~equal], q[~equal])))
        runs = left + (runs[-1:] if len(runs) % 2 else [])
    return runs[0]


def _merge_chunk(table: pa.Table) -> pa.RecordBatch:
    """Of first windows (whole anchors), those that come first elsewhere, as ranges to remove."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    shard, start = col[_SHARD].to_numpy(), col["start"].to_numpy()
    order = np.lexsort((start, col[_D].to_numpy(), shard, col[_H].to_numpy(), _ranks(col["doc_id"])))
    table = table.take(pa.array(order))
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    raw = np.frombuffer(b"".join(col["bytes"].to_pylist()), np.uint8)
    n = pc.binary_length(col["bytes"]).to_numpy().astype(np.int64) - LENGTH + 1
    base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    owners = np.arange(len(row))  # in the order of documents and offsets
    views = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    keys = np.ascontiguousarray(views[_spread(base, n)]).view(f"S{LENGTH}").ravel()
    shard = col[_SHARD].to_numpy()[row]
    by = np.lexsort((keys, shard))
    cuts = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1]])).tolist()
    lost = np.zeros(len(owners), bool)
    merged([(keys[by[lo:hi]], owners[by[lo:hi]]) for lo, hi in zip(cuts, [*cuts[1:], len(by)], strict=True)], lost)
    begin = lost & ~np.concatenate([[False], lost[:-1] & (row[1:] == row[:-1])])
    end = lost & ~np.concatenate([lost[1:] & (row[1:] == row[:-1]), [False]])
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    head = np.concatenate([[0], np.cumsum(n)])[:-1]
    starts = col["start"].to_numpy()[row[a]] + a - head[row[a]]
    return pa.RecordBatch.from_arrays([pa.array(col[_SHARD].to_numpy()[row[a]]), pa.array(col[_D].to_numpy()[row[a]]), pa.array(starts), pa.array(starts + (b - a) + LENGTH)], names=[_SHARD, _D, "start", "end"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by anchor: chunks end where an anchor ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            h = batch.column(0).to_numpy()
            if held and size >= CHUNK:
                same = int(np.searchsorted(h, held[-1].column(0)[-1].as_py(), "right"))
                if same < batch.num_rows:
                    yield _merge_chunk(pa.Table.from_batches([*held, batch.slice(0, same)]))
                    held, size, batch = [], 0, batch.slice(same)
                    continue
                held.append(batch)
                break
            length = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("bytes"))).to_numpy())
            fit = int(np.searchsorted(length, CHUNK - size)) + 1
            held.append(batch.slice(0, fit))
            size += int(length[min(fit, len(length)) - 1])
            batch = batch.slice(fit)
    if held:
        yield _merge_chunk(pa.Table.from_batches(held))


# ------------------------------------------------------------------------------------------------------- the whole


def _ranges(base: DataFrame) -> str:
    """The side table of removed ranges of all shards."""
    of = Window.partitionBy("h")
    anchors = summaries(base).withColumns({"total": F.sum("n").over(of), "lo": F.min(_SHARD).over(of), "hi": F.max(_SHARD).over(of)}).where("total > 1")
    known = write_side(anchors.select(_SHARD, "h", (F.col("lo") < F.col("hi")).alias("crossed"), (F.col("n") > 1).alias("again"), (F.col("total") > HOT).alias("hot")))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows, side in with_side(batches, known, "h"):
            out = _sorted_shard(shard, rows, side)
            if out is not None:
                yield out

    folder, kind = shared_dir(base.sparkSession), base.schema["doc_id"].dataType.simpleString()
    ddl = f"h long, {_SHARD} long, {_D} long, doc_id {kind}, {_H} long, start long, end long, hot boolean, digest binary, bytes binary"
    sorted_ = base.select("doc_id", _H, _SHARD, _D, "text").mapInArrow(sort, ddl)
    sorted_.write.option("parquet.block.size", 1 << 30).option("compression", "zstd").parquet(folder)
    first = base.sparkSession.read.schema(ddl).parquet(folder)
    place = [_SHARD, _D, "start", "end"]
    local = first.where("h is null").select(*place)

    # Equal pieces: the first stays.  They have one row a shard; nothing is dealt by an anchor that may be hot.
    order = [F.col("doc_id").isNull(), "doc_id", _H, _SHARD, _D, "start"]
    nth = F.row_number().over(Window.partitionBy("h", "digest").orderBy(*order))
    pieces = spool(first.where("h is not null").drop("bytes").withColumn("nth", nth).select(*place, "h", "hot", "nth"))
    settled = pieces.where("nth > 1").select(*place)
    # An anchor with several first pieces needs their bytes, or, if it is hot, the digests of their windows.
    left = pieces.where("nth = 1")
    several = left.where("not hot").withColumn("kinds", F.count("*").over(of)).where("kinds > 1").select(_SHARD, _D, "start")
    edges = write_side(several.union(left.where("hot").select(_SHARD, _D, "start")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, side in with_side(batches, edges, "start"):
            if side:
                wanted = pa.table({_D: side[_D], "start": side["start"]})
                for sub in rows:
                    at = np.arange(sub.num_rows)
                    here = pa.table({_D: sub.column(sub.schema.get_field_index(_D)), "start": sub.column(sub.schema.get_field_index("start")), "at": at})
                    hit = np.sort(here.join(wanted, [_D, "start"], join_type="left semi").column("at").to_numpy())
                    if len(hit):
                        yield from _split(sub.take(pa.array(hit)))

    needed = spool(first.where("h is not null").mapInArrow(fetch, ddl))
    cold = needed.where("not hot").drop("hot", "digest")
    away = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_merge, f"{_SHARD} long, {_D} long, start long, end long")
    dealt = needed.where("hot").drop("bytes").withColumn("nth", nth).where("nth > 1").select(*place)
    return write_side(local.union(settled).union(away).union(dealt))


def _split(pieces: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces as they are; those at hot anchors as their windows, with digests and without bytes."""
    hot = pieces.column(pieces.schema.get_field_index("hot"))
    cold, rows = pieces.filter(pc.invert(hot)), pieces.filter(hot)
    if cold.num_rows:
        yield pa.RecordBatch.from_arrays(cold.columns, names=cold.schema.names)  # one schema for both
    if rows.num_rows:
        col = lambda c: rows.column(rows.schema.get_field_index(c))
        size = col("end").to_numpy() - col("start").to_numpy()
        n = size - LENGTH + 1
        which = np.repeat(np.arange(len(n)), n)
        begin = _spread(np.cumsum(size) - size, n)
        start = _spread(col("start").to_numpy(), n)
        told = {"start": pa.array(start), "end": pa.array(start + LENGTH), "digest": _digests(b"".join(col("bytes").to_pylist()), begin, begin + LENGTH), "bytes": pa.nulls(len(which), pa.binary())}
        yield pa.RecordBatch.from_arrays([told[c] if c in told else col(c).take(pa.array(which)) for c in rows.schema.names], names=rows.schema.names)


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text without the ranges (sorted by start), and how many maximal runs are removed."""
    parts, at, n = [], 0, 0
    upto = -1
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if a > upto:
            parts.append(raw[at:a])
            n += 1
        upto = max(upto, b)
        at = upto
    return b"".join([*parts, raw[at:]]), n


def _rewritten(docs: DataFrame, columns: list[str], result: str, make) -> DataFrame:
    """mapInArrow over the spooled documents; ``make(rows, kept texts, spans)`` gives the batch."""
    base = _spooled(docs)
    folder = _ranges(base)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, side in with_side(batches, folder, _D):
            if side:
                order = np.lexsort((side["start"], side[_D]))
                side = {c: x[order] for c, x in side.items()}
            for sub in rows:
                texts = [x or b"" for x in sub.column(sub.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
                place = sub.column(sub.schema.get_field_index(_D)).to_numpy()
                if side:
                    lo, hi = np.searchsorted(side[_D], place), np.searchsorted(side[_D], place, "right")
                    kept = [_kept(x, side["start"][a:b], side["end"][a:b]) for x, a, b in zip(texts, lo, hi, strict=True)]
                else:
                    kept = [(x, 0) for x in texts]
                yield make(sub, texts, kept)

    return base.select(*columns, _SHARD, _D).mapInArrow(each, result)


def removal(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(rows: pa.RecordBatch, texts: list[bytes], kept: list[tuple[bytes, int]]) -> pa.RecordBatch:
        sizes = [len(x) for x in texts]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array([a - len(k) for a, (k, _) in zip(sizes, kept, strict=True)], pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in kept])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = only(docs, doc_id="doc_id", text="text")
    return _rewritten(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts (characters that were cut go), all columns; n_chars follows, and
    documents of which nothing is left go."""
    docs, named = set_aside(docs, "doc_id", "text", "n_chars")
    columns = docs.columns

    def make(rows: pa.RecordBatch, texts: list[bytes], kept: list[tuple[bytes, int]]) -> pa.RecordBatch:
        left = [k.decode("utf-8", "ignore") if n else None for k, n in kept]
        out = []
        for c in columns:
            x = rows.column(rows.schema.get_field_index(c))
            if c == "text":
                x = pa.array([v if t is None else t for v, t in zip(x.to_pylist(), left, strict=True)], x.type)
            elif c == "n_chars":
                x = pa.array([v if t is None else len(t) for v, t in zip(x.to_pylist(), left, strict=True)], x.type)
            out.append(x)
        return pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array([t != "" for t in left]))

    return named(_rewritten(docs, columns, docs.schema, make))
