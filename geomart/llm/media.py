"""Media columns: content-addressed payloads in tar shards.

A payload is stored once under its digest, as an 8-bit grey image (PNG, one row of samples) in a tar shard on shared
storage. Digests come from a first pass over the texts. Payloads of a digest that occurs once are written by the task
that reads them; only those of a repeated digest are shuffled, one copy from each task. Metadata columns come from range
reads of the image header alone, features from range reads of the whole image; both are dealt to tasks by shard and
offset, so a task reads a stretch of one shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import Ranges, open_new
from .common import Bitmap, cut, join_unique, scratch, text_or_empty

ROW = 64
HEADER = 33
MAGIC = b"\x89PNG\r\n\x1a\n"
MANIFEST = "digest string, shard string, offset long, length long"
#: Bytes of a shard that a task reads.
STRETCH = 16 << 20
STORED = "digest string, shard string, offset long, length long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, bits int"


def padded(data: bytes, unit: int = ROW) -> bytes:
    """data and bytes 0 up to a positive multiple of `unit`."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit PNG of one row with the payload's bytes as samples; the row begins with filter type 0."""
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"\0" + payload, level)) + _chunk(b"IEND", b"")


def image_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits from the first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", head[16:25])


def from_image(data: bytes) -> bytes:
    """The samples of an image that to_image made."""
    width, height, _ = image_header(data)
    at, body = HEADER, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean, deviation, entropy of the samples and mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    mean = float(p @ np.arange(256))
    spread = float(max(0.0, p @ np.arange(256.0) ** 2 - mean**2)) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.6f};std={spread:.6f};entropy={entropy:.6f};step={float(np.abs(np.diff(x.astype(np.int16))).mean()):.6f}"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes, digest (of the padded payload) of each row."""
    raw = F.encode(text_or_empty(), "UTF-8")
    n = F.octet_length(text_or_empty())
    pad = F.when(n == 0, F.lit(ROW)).otherwise(F.pmod(-n, F.lit(ROW)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), n.cast("long").alias("n_bytes"), F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad))), 256).alias("digest"))


def store(payloads: DataFrame, folder: str, skip: Bitmap | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes the payloads of digest and text into tar shards under `folder` and returns digest, shard, offset and length; digests that `skip` lets pass are left out.

    A shard's name is new for every attempt of a task, so a lost or repeated attempt leaves no mark on what the manifest
    names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in batches:
            rows = []
            if skip is not None:
                batch = batch.filter(pa.array(~skip.held(batch.column(2))))
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None or at > shard_bytes:
                    if out is not None:
                        out.write(bytes(2 * tarfile.BLOCKSIZE))
                        out.close()
                    uri, at = f"{folder}/{uuid.uuid4().hex}.tar", 0
                    out = open_new(uri)
                image = to_image(padded(text.as_py().encode("utf-8", "surrogatepass")))
                member = tarfile.TarInfo(f"{digest}.png")
                member.size = len(image)
                head = member.tobuf(tarfile.USTAR_FORMAT)
                block = head + image + bytes(-len(image) % tarfile.BLOCKSIZE)
                rows.append((digest, uri, at + len(head), len(image)))
                out.write(block)
                at += len(block)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * tarfile.BLOCKSIZE))
            out.close()

    slot = [] if skip is None else [skip.slot(["digest"]).alias("slot")]
    return payloads.select("digest", "text", *slot).mapInArrow(write, MANIFEST)


def stretches(places: DataFrame) -> DataFrame:
    """places, dealt to tasks by shard and stretch of it, in the order of the shard."""
    total = places.agg(F.sum("length")).first()[0] or 0
    return places.repartition(min(10_000, 1 + total // STRETCH), "shard", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("shard", "offset")


def header_columns(places: DataFrame) -> DataFrame:
    """width, height and bits of each stored image, from a read of its first HEADER bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            digests, shards, offsets = (c.to_pylist() for c in batch.columns)
            found = [image_header(source.read(s, o, HEADER)) for s, o in zip(shards, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), *(pa.array([x[k] for x in found], pa.int32()) for k in range(3))], names=["digest", "width", "height", "bits"])
        source.close()

    return stretches(places).select("digest", "shard", "offset").mapInArrow(read, "digest string, width int, height int, bits int")


def read_features(places: DataFrame) -> DataFrame:
    """places with what the stored images hold: header columns from a read of the header, then sizes, digests and features from the whole image."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = [x.split()[0] for x in STORED.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                header = image_header(source.read(shard, offset, HEADER))
                image = source.read(shard, offset, length)
                payload = from_image(image)
                rows.append((digest, shard, offset, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), describe(payload), *header))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)
        source.close()

    return stretches(places).select("digest", "shard", "offset", "length").mapInArrow(read, STORED)


def media_table(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, digest, shard, offset, length, width, height, bits.

    Null and empty texts store 64 zero bytes. Equal texts refer to one stored image. An empty table gives an empty
    table; repeated rows come back as often as they occur; columns beside doc_id and text are not read.
    """
    named = digests(docs)
    rows = cut(named.select("doc_id", "n_bytes", "digest"), "digests")
    shared = cut(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "shared")
    repeated = Bitmap(shared, ["digest"], shared.count())
    folder = folder or scratch(docs.sparkSession, "media")
    once = repeated.split(named.select("digest", "text"), ["digest"], True).groupBy("digest").agg(F.first("text").alias("text"))
    manifest = cut(store(named, folder, repeated).unionByName(store(once, folder)), "manifest")
    features = cut(read_features(manifest), "features")
    return join_unique(rows, features, ["digest"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")
