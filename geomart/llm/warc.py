"""WARC archives: writing with revisits, reading by boundary chains.

The writer puts a record per page into uncompressed archives. The reader knows only the files: tasks scan byte ranges
for the version line and emit, for every place that parses as a record head, the offset of its successor. Pointer
jumping from offset 0 of each file keeps the places that a chain of successors reaches; a version line inside a payload
is never on that chain. A chain that doesn't end at its file's size raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import Ranges, open_new
from .common import Bitmap, cut, join_unique, scratch

MAGIC = b"WARC/1.1\r\n"
#: Bytes read beyond a range at first; a longer head is read on.
HEAD_BYTES = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = b"1970-01-01T00:00:00Z"
FILES = "file string, bytes long, records long"
#: Bytes of an archive that a task reads.
SPLIT = 16 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> bytes:
    """A header value: no line ends."""
    return " ".join((text or "").split()).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())
    head = [MAGIC[:-2], b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + name, b"WARC-Date: " + DATE, b"WARC-Target-URI: " + _line(url), b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode()]
    block = HTTP
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and their length in bytes if data begins with a whole record head."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(MAGIC) or end < 0:
        return None
    fields = {}
    for line in data[len(MAGIC) : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """payload_sha1, first_id for payloads that several pages share; narrow, on shared storage."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    seen = known.filter(F.octet_length("html") >= least_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("payload_sha1"))
    return cut(seen.groupBy("payload_sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages")).filter("pages > 1").select("payload_sha1", "first_id"), "revisits")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record per page into archives under `folder`; returns file_id, file, bytes and records of each archive, on shared storage.

    Only pages whose payload is shared need a partner, and only these are shuffled. Archives are named anew by every
    attempt of a task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at, n, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if out is None or at > file_bytes:
                    if out is not None:
                        out.close()
                        done.append((uri, at, n))
                    uri, at, n = f"{folder}/{uuid.uuid4().hex}.warc", 0, 0
                    out = open_new(uri)
                page, url, html, first = row
                data = record(page, url, html.as_py().encode("utf-8", "surrogatepass"), None if first == page else first)
                out.write(data)
                at, n = at + len(data), n + 1
        if out is not None:
            out.close()
            done.append((uri, at, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), *(pa.array([x[k] for x in done], pa.int64()) for k in (1, 2))], names=["file", "bytes", "records"])

    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    known = known.withColumn("payload_sha1", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "UTF-8"))))
    shared = revisits(pages, least_bytes)
    passing = Bitmap(shared, ["payload_sha1"], shared.count())
    alone = passing.split(known, ["payload_sha1"], False).withColumn("first_id", F.lit(None).cast("long"))
    again = join_unique(passing.split(known, ["payload_sha1"], True), shared, ["payload_sha1"], "left")
    dealt = [x.select("page_id", "url", "html", "first_id").mapInArrow(write, FILES) for x in (alone, again)]
    return cut(cut(dealt[0].unionByName(dealt[1]), "archives").withColumn("file_id", F.monotonically_increasing_id()), "archives")


def tasks_for(files: DataFrame, split_bytes: int = SPLIT) -> int:
    return int(min(10_000, 1 + (files.agg(F.sum("bytes")).first()[0] or 0) // split_bytes))


def candidates(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """file_id, offset, next_offset of every place in the archives that parses as a record head; `files` has file_id, file and bytes."""
    splits = files.select("file_id", "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            for number, uri, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                data = source.read(uri, begin, min(split_bytes + HEAD_BYTES, size - begin))
                found, at, end = [], data.find(MAGIC), -1
                while 0 <= at < split_bytes:
                    if end < at:
                        end, seen, step = data.find(b"\r\n\r\n", at), at, HEAD_BYTES
                        while end < 0 and begin + len(data) < size and all(b":" in x for x in data[at + len(MAGIC) : max(at + len(MAGIC), data.rfind(b"\r\n"))].split(b"\r\n") if x):
                            seen = max(at, len(data) - 3)
                            data += source.read(uri, begin + len(data), min(step, size - begin - len(data)))
                            end, step = data.find(b"\r\n\r\n", seen), 2 * step
                    head = parse_head(data[at : end + 4]) if end >= 0 else None
                    if head is not None:
                        found.append((begin + at, begin + at + head[1] + int(head[0]["content-length"]) + 4))
                    at = data.find(MAGIC, at + 1)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["file_id", "offset", "next_offset"])
        source.close()

    return splits.repartition(tasks_for(files, split_bytes), "file", "begin").mapInArrow(scan, "file_id long, offset long, next_offset long")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches, by pointer jumping: each round doubles the chain's length. All joins are shuffled: both sides grow with the archives."""
    jumps = found.select("file_id", "offset", F.col("next_offset").alias("to"))
    reached, n = found.filter("offset = 0").select("file_id", "offset"), None
    known = found.select("file_id", "offset").hint("merge")
    while True:
        further = reached.join(jumps.hint("merge"), ["file_id", "offset"]).select("file_id", F.col("to").alias("offset"))
        grown = cut(reached.union(further.join(known, ["file_id", "offset"], "left_semi")), "reached")
        before, n = n, grown.count()
        if n == before:
            return found.join(grown.hint("merge"), ["file_id", "offset"], "left_semi")
        reached = grown
        onward = jumps.select("file_id", F.col("offset").alias("to"), F.col("to").alias("after"))
        jumps = cut(jumps.join(onward.hint("merge"), ["file_id", "to"]).select("file_id", "offset", F.col("after").alias("to")), "jumps")


def whole_chains(files: DataFrame, found: DataFrame) -> DataFrame:
    """The candidates on the chains of `files`; an error if one of these doesn't end where its file does or doesn't hold as many records as were written."""
    chain = cut(reachable(found), "chains")
    ends = chain.groupBy("file_id").agg(F.max("next_offset").alias("end"), F.count("*").alias("held"))
    broken = files.filter("bytes > 0").join(ends, "file_id", "left").filter(~F.col("end").eqNullSafe(F.col("bytes")) | ~F.col("held").eqNullSafe(F.col("records"))).select("file", "bytes", "records", "end", "held").limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{x['file']}: the chain of records ends at {x['end']} of {x['bytes']} bytes and holds {x['held']} of {x['records']} records" for x in broken))
    return chain


def read_records(files: DataFrame, chain: DataFrame) -> DataFrame:
    """Parses each record of chain (file_id, offset, next_offset) and checks a response's digest against its bytes. Records are dealt to tasks by file and stretch of it, however few bytes their addresses take."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            rows = []
            for uri, offset, end in zip(*(c.to_pylist() for c in batch.columns)):
                data = source.read(uri, offset, end - offset)
                fields, at = parse_head(data)
                block = data[at : at + int(fields["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and digest != base32_sha1(payload):
                    raise ValueError(f"{uri} at {offset}: the payload isn't what its digest says")
                ids = [x[10:-1] for x in (fields["warc-record-id"], fields.get("warc-refers-to", ""))]
                rows.append((int(ids[0]) if ids[0] else None, fields.get("warc-target-uri", ""), len(payload) if kind == "response" else None, digest, kind, int(ids[1]) if ids[1] else None, uri, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"])
        source.close()

    records = join_unique(chain, files.select("file_id", "file"), ["file_id"]).repartition(tasks_for(files), "file", F.floor(F.col("offset") / SPLIT)).sortWithinPartitions("file", "offset")
    return records.select("file", "offset", "next_offset").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset of each page, as read back from its archives.

    A null html counts as empty. Of pages with equal payloads the one with the smallest page_id is the response; rows
    that repeat that page_id are responses too, and so are payloads below `least_bytes`. A page without a page_id never
    is what others refer to unless all its copies lack one; those are all responses. An empty table gives an empty
    table; columns beside page_id, url and html are not read.
    """
    files = write_archives(pages, folder or scratch(pages.sparkSession, "warc"), least_bytes)
    found = cut(candidates(files), "candidates")
    records = cut(read_records(files, whole_chains(files, found)), "records")
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    again = join_unique(records.filter("record_type = 'revisit'").drop("payload_bytes"), sizes, ["refers_to", "payload_digest"], "left").withColumnRenamed("full_bytes", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]
    return records.filter("record_type = 'response'").select(columns).unionByName(again.select(columns))
