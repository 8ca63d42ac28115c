r"""WARC archives: written with an index, read back by coalesced byte ranges.

Pages are spooled once with the digests of their payloads, in shards; which page of equal payloads responds is found by
narrow rows, one a shard and digest, so a payload that a third of all pages share is neither shuffled nor gathered.  What
is decided of a shard comes back to it by digest (``shards``).

The writer gives each record a gzip member of its own in a ``.warc.gz`` file of the shared folder, and returns one
index row a record: file, offset, length, URL, digest.  Readers choose records by the index alone, sort the chosen
ranges, join neighbours to one read, and parse what they have read.

Files have a name of their own for every attempt of a task, and only attempts that Spark committed are in the index;
a lost executor leaves at most an unlisted file.

Cases.  Null payload: empty payload.  Null URL: no WARC-Target-URI; the index has null.  A URL that a header line cannot
carry is percent-encoded there, and whole in a header of its own, which the reader takes.  Null page_id: a record
without an identity, never the one that others refer to while some page of its payload has an id; where none has, all
are responses.  Repeated rows: every row is a record; rows that repeat the page_id of the response are responses.
Empty table: empty index, no file.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import only, shared_dir, small_batches, spool
from cartoflow.llm.shards import PART_SHIFT, SHARD, side_of_part, write_side

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Neighbouring ranges are read at once up to this gap, and up to this length together.
GAP, SPAN = 1 << 16, 1 << 22
#: The read-back has a task for each SPAN of archive, of longer spans beyond so many tasks.
READERS = 20_000


def base32_sha1(column) -> "F.Column":
    """Bare upper-case base32 of the SHA-1 of a binary or string column, in built-in functions only."""
    digest = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


class Plan(NamedTuple):
    """Spooled pages (page_id, url, payload, payload_bytes, payload_digest, __shard), and the folder of what their shards
    are told: the responding page of each digest that occurs again."""

    pages: DataFrame
    firsts: str


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> Plan:
    """Each page with its digest.  Of equal payloads of at least ``least`` bytes the smallest id responds."""
    rows = only(pages, page_id=page_id, url=url, payload=payload).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    rows = spool(rows.withColumn(SHARD, F.shiftleft(F.spark_partition_id().cast("long"), PART_SHIFT)))
    found = rows.where(F.col("payload_bytes") >= least).groupBy(SHARD, "payload_digest").agg(F.min("page_id").alias("least_id"), F.count("*").alias("n"))
    found = spool(found)  # a digest has one row a shard at most, however many its pages
    again = found.groupBy("payload_digest").agg(F.min("least_id").alias("first_id"), F.sum("n").alias("all")).where("all > 1 and first_id is not null")
    return Plan(rows, write_side(found.select(SHARD, "payload_digest").join(again.drop("all"), "payload_digest")))


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def _header(url: str) -> str:
    """A header line takes neither control characters nor others than ASCII."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, kind: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        plain = _header(url)
        lines += [f"WARC-Target-URI: {plain}"]
        lines += [f"X-Target-Url: {base64.b64encode(url.encode()).decode()}"] if plain != url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload (after the HTTP headers) and the length of the record at the start of ``data``."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2], len(head) + 4 + n + 4


def _gzip(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(plan: Plan, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write planned records (see ``plan_records``) below ``folder``; the index, itself a Parquet table there."""
    spark, (pages, firsts) = plan.pages.sparkSession, plan
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/data/{uuid.uuid4().hex}.warc.gz"
        part, first_of = None, {}
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                index = []
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload_digest", "payload_bytes", SHARD)]
                payloads = batch.column(batch.schema.get_field_index("payload"))
                for i, (page_id, url, digest, n, shard) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                    if part != shard >> PART_SHIFT:
                        part = shard >> PART_SHIFT
                        side = side_of_part(firsts, part)
                        first_of = dict(zip(side["payload_digest"].tolist(), side["first_id"].tolist(), strict=True)) if side else {}
                    refers_to = first_of.get(digest)
                    kind, refers_to = ("response", None) if refers_to is None or refers_to == page_id else ("revisit", refers_to)
                    member = _gzip(record_bytes(page_id, url, b"" if kind == "revisit" else payloads[i].as_py(), digest, n, kind, refers_to, date))
                    out.write(member)
                    index.append((name, at, len(member), page_id, url, digest, n, kind, refers_to))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    pages.select("page_id", "url", "payload", "payload_digest", "payload_bytes", SHARD).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists, read by ranges: those of a few MB of a file meet, are sorted, and read together.

    Each record's payload is checked against its digest; a mismatch raises.  A revisit has no payload of its own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            ranges = batch.to_pydict()
            rows = list(zip(ranges["file"], ranges["offset"], ranges["length"], strict=True))
            i = 0
            while i < len(rows):
                name, start, length = rows[i]
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][0] == name and rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - start <= SPAN:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if opened != name:
                    store, path = fs.FileSystem.from_uri(name)
                    source, opened = store.open_input_file(path), name
                chunk, found = source.read_at(end - start, start), []
                for _, offset, size in rows[i:j]:
                    fields, payload, _ = parse_record(zlib.decompress(chunk[offset - start : offset - start + size], 31))
                    found.append(_row(fields, payload, payloads))
                i = j
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _RECORD_TYPES, strict=True)], names=_RECORD_NAMES)

    small_batches(index.sparkSession)
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    span = max(SPAN, total // READERS)
    place = F.floor(F.col("offset") / SPAN)
    # By bytes of archive: the index rows alone are few, and would all be read in one task.
    chosen = index.select("file", "offset", "length").repartition(total // span + 1, F.col("file"), place).sortWithinPartitions("file", "offset")
    out = chosen.mapInArrow(read, RECORD)
    return out if payloads else out.drop("payload")


def _row(fields: dict[str, str], payload: bytes, keep: bool) -> tuple:
    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    url = base64.b64decode(fields["x-target-url"]).decode() if "x-target-url" in fields else fields.get("warc-target-uri")
    return number("x-page-id"), url, n, digest, kind, number("x-refers-to-page"), payload if keep and kind == "response" else None


_RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_RECORD_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, payloads: bool = False) -> DataFrame:
    """Write the pages as archives, then read all of them back by the index."""
    folder = folder or shared_dir(pages.sparkSession)
    return read_warc(write_warc(plan_records(pages, least=least), folder), payloads)
