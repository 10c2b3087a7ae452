"""Packing by power-of-two decomposition: every sequence is one piece of one
document, of a length that is a power of two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tokens import encoder

#: Parts into which each bucket of equal lengths is cut to number its pieces.
PARTS = 1024


def binary_pieces(n: int, most: int) -> list[int]:
    """Lengths, longest first, that sum up to n: whole ones of ``most`` (a
    power of two), then the binary digits of the rest."""
    return [most] * (n // most) + [1 << k for k in reversed(range((n % most).bit_length())) if (n % most) >> k & 1]


def decompose(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens.

    A document is its token ids and then ``end_id``; a null text is empty, so
    it is that id alone. Null ids and rows that repeat an id are documents of
    their own; other columns of any name go. Empty table: no rows. Ids come
    from the tokenizer; long texts are encoded in runs and their pieces go out
    in batches. No shuffle.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(it):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in it:
            rows: list[tuple] = []
            size = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                raw = (enc.ids(text).tobytes() if text else b"") + end
                n, at = len(raw) // 4, 0
                for k in binary_pieces(n, most):
                    rows.append((i, at, k, raw[4 * at : 4 * (at + k)], n))
                    at += k
                size += len(raw)
                if size > 8 << 20:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)

    names, types = ["doc_id", "start", "length", "ids", "doc_tokens"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.selectExpr(
        f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text"
    ).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def number_sequences(pieces: DataFrame, parts: int = PARTS) -> DataFrame:
    """``pieces`` with sequence_id and offset. Pieces of one length form a
    bucket; each is a sequence, so its offset is 0 and nothing is padded.

    The number is the piece's rank in its part of the bucket, the part and the
    bucket, interleaved: unique, the same in every run, and the bucket is
    ``sequence_id % 64``, the power of two. Parts are cut by hash, so a bucket
    that holds most pieces is ``parts`` tasks. Equal rows of repeated
    documents are interchangeable.
    """
    keys = [F.col(c) for c in ("doc_id", "start", "doc_tokens") if c in pieces.columns]
    rest = [F.col(c) for c in pieces.columns if c not in ("doc_id", "start", "doc_tokens", "ids")]
    bucket = F.log2(F.col("length").cast("double")).cast("int")
    p = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int")).withColumn("__bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("__bucket", "__part").orderBy(*keys, *rest)).cast("long") - 1
    return p.withColumn(
        "sequence_id", (rank * parts + F.col("__part")) * 64 + F.col("__bucket")
    ).withColumn("offset", F.lit(0).cast("long")).drop("__part", "__bucket")
