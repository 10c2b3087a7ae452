"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a gray image (PNG, 8-bit samples, 64 to a row) under the
digest of its bytes; rows carry digest, shard, offset and length. Columns that
the header answers are filled by reading only the header's range.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .storage import new_path, written

#: Samples to a row of the image; what payloads are padded to. Bytes after which
#: a task starts another shard.
WIDTH, SHARD_BYTES = 64, 256 << 20
#: Signature of the format and length of signature, first chunk and its checksum (fixed values).
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes, level: int = 6) -> bytes:
    """A PNG whose samples are the payload's bytes, row by row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows
    return SIGNATURE + _chunk(
        b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    ) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), level)) + _chunk(b"IEND", b"")


def image_size(header: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER bytes."""
    if header[:8] != SIGNATURE or header[12:16] != b"IHDR" or zlib.crc32(header[12:29]) != struct.unpack(">I", header[29:33])[0]:
        raise ValueError("not an image header")
    return struct.unpack(">II", header[16:24])


def from_image(image: bytes) -> bytes:
    """The payload of ``to_image``; a damaged image raises."""
    width, height = image_size(image[:HEADER])
    size = struct.unpack(">I", image[HEADER : HEADER + 4])[0]
    data = image[HEADER + 4 : HEADER + 8 + size]
    if data[:4] != b"IDAT" or zlib.crc32(data) != struct.unpack(">I", image[HEADER + 8 + size : HEADER + 12 + size])[0]:
        raise ValueError("damaged image")
    return np.frombuffer(zlib.decompress(data[4:]), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def payload_column(text: str = "text"):
    """UTF-8 of the text (null: empty), filled with zeros to a positive
    multiple of WIDTH."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(raw) / WIDTH) * WIDTH).cast("int")
    return F.rpad(raw, size, F.lit(b"\0"))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path for a URI as Spark writes it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def store(payloads: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads (column payload) as images into tar files in
    ``folder``; return (digest, shard, offset, length, media_sha256), one row
    per digest.

    Each task writes shards of about ``shard_bytes`` (a payload is never
    divided) and in them each payload once; the index names
    one place of each digest, so of a third of all rows that are equal one
    copy per task is stored and one is ever read. No payload is shuffled. A
    shard is written under a new name and moved when whole; the index, a table
    in the shared folder, names it only then, so a task that is run again
    leaves at most a file nobody refers to.
    """
    folder = folder or new_path(payloads.sparkSession, "media")
    _open(folder)  # fails early for a store that can't be written by range

    def write(it):
        seen, name, out = set(), None, []

        def close():
            sink.write(b"\0" * 1024)
            sink.close()
            files.move(f"{base}/_{name}", f"{base}/{name}.tar")
            digest, at, length, sha = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(digest), pa.array([f"{folder}/{name}.tar"] * len(out)), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(sha)],
                ["digest", "shard", "offset", "length", "media_sha256"]
            )

        for b in it:
            for payload in b.column(0):
                payload = payload.as_py()
                digest = hashlib.sha256(payload).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                if name is None:
                    files, base = _open(folder)
                    files.create_dir(base)
                    name, at, out = uuid.uuid4().hex, 0, []
                    sink = files.open_output_stream(f"{base}/_{name}")
                image = to_image(payload)
                info = tarfile.TarInfo(f"{digest.hex()}.png")
                info.size = len(image)
                head = info.tobuf()
                body = image + b"\0" * (-len(image) % 512)
                sink.write(head + body)
                out.append((digest.hex(), at + len(head), len(image), hashlib.sha256(image).hexdigest()))
                at += len(head) + len(body)
                if at >= shard_bytes:
                    yield close()
                    name = None
        if name is not None:
            yield close()

    done = written(payloads.select("payload").mapInArrow(write, "digest string, shard string, offset long, length long, media_sha256 string"), "media-index")
    return done.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "media_sha256")).alias("at")).select("digest", "at.*")


def ranges(index: DataFrame, read, schema: str) -> DataFrame:
    """``read(open_range, rows)`` over the stored objects, shard by shard:
    open_range(offset, length) reads from the shard of the rows at hand."""

    def run(it):
        opened: dict = {}
        for b in it:
            rows = b.to_pylist()
            for shard in dict.fromkeys(r["shard"] for r in rows):
                if shard not in opened:
                    files, path = _open(shard)
                    opened = {shard: files.open_input_file(path)}
                own = [r for r in rows if r["shard"] == shard]
                for first in range(0, len(own), 256):
                    yield read(lambda at, n: opened[shard].read_at(n, at), own[first : first + 256])

    return index.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def headers(index: DataFrame) -> DataFrame:
    """(digest, width, height) by reading HEADER bytes of each object."""

    def read(get, rows):
        sizes = [image_size(get(r["offset"], HEADER)) for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r["digest"] for r in rows]), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64())],
            ["digest", "width", "height"]
        )

    return ranges(index, read, "digest string, width long, height long")


def contents(index: DataFrame) -> DataFrame:
    """What reading each object back shows: digest, width and height (from the
    header's range alone), payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature: size, mean and deviation of the
    samples and their histogram over eight equal ranges; shard, offset and
    length as in the index. An object whose bytes
    aren't those that were stored raises."""
    names = [
        "digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard",
        "offset", "length"
    ]

    def read(get, rows):
        out = []
        for r in rows:
            width, height = image_size(get(r["offset"], HEADER))
            image = get(r["offset"], r["length"])
            payload = from_image(image)
            sha = hashlib.sha256(payload).hexdigest()
            if sha != r["digest"] or hashlib.sha256(image).hexdigest() != r["media_sha256"]:
                raise ValueError(f"object {r['digest']} in {r['shard']} is damaged")
            x = np.frombuffer(payload, np.uint8)
            hist = np.bincount(x >> 5, minlength=8)
            out.append((r["digest"], width, height, len(payload), sha, zlib.crc32(payload[-WIDTH:]), len(image), r["media_sha256"], f"{width}x{height} mean={x.mean():.3f} std={x.std():.3f} hist={','.join(map(str, hist))}", r["shard"], r["offset"], r["length"]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return ranges(
        index, read,
        "digest string, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long"
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length and what ``contents``
    finds, one row per row of ``docs``. Null texts are empty ones; null and
    repeated ids are rows like others; equal texts share one object; other
    columns of any name go. A payload of any length is one object, held as a
    whole by one task. Empty table: no rows."""
    paid = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"),
        payload_column(text_col).alias("payload")
    )
    stored = contents(store(paid.select("payload"), folder))
    return paid.select("doc_id", "n_bytes", F.sha2("payload", 256).alias("digest")).join(stored, "digest")
