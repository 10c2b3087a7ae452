"""Sets of sources as bitmaps, for counting itemsets.

Sources are dealt into buckets by hash and numbered there; what an item, or a
set of items, covers is a row a bucket that holds a bit for each source. Two
sets meet by AND, and bits are counted, instead of joining every occurrence of
one with every occurrence of the other; a source with many items is a bit of
each, so it weighs no more than others. Sparse bitmaps are stored as positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Sources of a bucket, and bytes of bitmaps of a bucket, at most about so many.
BUCKET, BYTES = 1 << 15, 64 << 20
#: Pairs of items that a task tries at most about.
PAIRS = 4 << 20
#: Rows that are handed on at once, at most about so many.
ROWS = 1 << 16
TIDS = "bucket long, width int, items array<string>, bits binary"
_ITEMS = pa.list_(pa.string())


def pack(at: np.ndarray, width: int) -> bytes:
    """Positions (sorted) among ``width`` bytes of bits: themselves after a 0,
    or the bitmap after a 1, whichever is shorter."""
    if 2 * len(at) < width:
        return b"\0" + at.astype("<u2").tobytes()
    row = np.zeros(width, np.uint8)
    np.bitwise_or.at(row, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return b"\1" + row.tobytes()


def unpack(stored: list[bytes], width: int) -> np.ndarray:
    """A row of bits for each, as numbers of 64."""
    rows = np.zeros((len(stored), width), np.uint8)
    for row, b in zip(rows, stored):
        if b[0]:
            row[:] = np.frombuffer(b, np.uint8, offset=1)
        else:
            at = np.frombuffer(b, "<u2", offset=1).astype(np.int64)
            np.bitwise_or.at(row, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return rows.view(np.uint64)


def positions(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))


def place(baskets: DataFrame, items: int) -> DataFrame:
    """Rows of two kinds from ``baskets`` (source_id, item and told; the first
    two distinct): those with bits hold what an item covers in a bucket, and
    for which of these sources it is told, the others (source_id, at) tell
    which source a bit stands for; a bucket's bits are in order of the sources.
    ``items``: how many different ones there are, which sets the buckets' size."""
    kind = baskets.schema["source_id"].dataType
    sources = baskets.agg(F.approx_count_distinct("source_id").alias("n")).first()["n"]
    per = max(64, min(BUCKET, 8 * BYTES // max(1, items)) * 3 // 4)  # hashing fills some buckets more
    buckets = max(1, -(-sources // per))
    schema = StructType.fromDDL(f"{TIDS}, told binary, at int").add("source_id", kind)

    def run(t: pa.Table) -> pa.Table:
        who = t.column("source_id").combine_chunks().dictionary_encode()
        sources = np.asarray(pc.sort_indices(who.dictionary))
        n, bucket = len(sources), t.column("bucket")[0].as_py()
        rank = np.empty(n, np.int64)
        rank[sources] = np.arange(n)
        at, told = rank[np.asarray(who.indices)], np.asarray(t.column("told").to_numpy(), bool)
        width = -(-n // 64) * 8
        what = t.column("item").combine_chunks().dictionary_encode()
        code = np.asarray(what.indices)
        order = np.lexsort((at, code))
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        runs, marks = np.split(at[order], cuts), np.split(told[order], cuts)
        k, names = len(runs), what.dictionary.to_pylist()
        return pa.table({
            "bucket": pa.array([bucket] * (k + n), pa.int64()), "width": pa.array([width] * (k + n), pa.int32()),
            "items": pa.array([[x] for x in names] + [None] * n, _ITEMS), "bits": pa.array([pack(r, width) for r in runs] + [None] * n, pa.binary()),
            "told": pa.array([pack(r[m], width) for r, m in zip(runs, marks)] + [None] * n, pa.binary()), "at": pa.array([None] * k + list(range(n)), pa.int32()),
            "source_id": pa.concat_arrays([pa.nulls(k, who.dictionary.type), who.dictionary.take(pa.array(sources))]),
        })

    dealt = baskets.where(F.col("source_id").isNotNull()).select("source_id", "item", "told", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(run, schema)


def meet(tids: DataFrame, size: int, items: int) -> DataFrame:
    """``TIDS`` and n (sources) of each set of ``size`` items that two of
    ``tids`` make which differ in their last item alone, where it covers a
    source. Sets of one bucket and beginning meet in a task; where whole
    buckets meet, as of single items, each task takes a slice of the pairs."""
    slices = max(1, -(-(items**2) // (2 * PAIRS))) if size == 2 else 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("last")
        bucket, width = t.column("bucket")[0].as_py(), t.column("width")[0].as_py()
        sets, own = t.column("items").to_pylist(), t.column("own").to_pylist()
        bits = unpack(t.column("bits").to_pylist(), width)
        found, stored, counts = [], [], []
        for i in range(len(sets) - 1):
            if own[i]:
                both = bits[i] & bits[i + 1 :]
                n = np.bitwise_count(both).sum(1)
                for j in np.flatnonzero(n).tolist():
                    found.append(sets[i] + sets[i + 1 + j][-1:])
                    stored.append(pack(positions(both[j]), width))
                    counts.append(int(n[j]))
        k = len(found)
        return pa.table(
            [
                pa.array([bucket] * k, pa.int64()), pa.array([width] * k, pa.int32()), pa.array(found, _ITEMS),
                pa.array(stored, pa.binary()), pa.array(counts, pa.int64())
            ],
            ["bucket", "width", "items", "bits", "n"]
        )

    last = F.element_at("items", -1)
    d = tids.select("bucket", "width", "items", "bits", last.alias("last"), F.slice("items", 1, size - 2).alias("head"))
    d = d.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    d = d.withColumn("own", F.pmod(F.xxhash64("last"), F.lit(slices)) == F.col("slice"))
    return d.groupBy("bucket", "head", "slice").applyInArrow(run, f"{TIDS}, n long")


def named(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """(bucket, at, items) of each bit, or of each bitmap's first ``most``;
    ROWS of them, or those of one bitmap, at once."""
    for b in batches:
        sizes, at, start, waiting = [], [], 0, 0
        for i, (x, w) in enumerate(zip(b.column("bits").to_pylist(), b.column("width").to_pylist()), 1):
            at.append(positions(unpack([x], w)[0])[:most])
            sizes.append(len(at[-1]))
            waiting += sizes[-1]
            if waiting >= ROWS or i == b.num_rows:
                rows = pa.array(start + np.repeat(np.arange(len(at)), sizes), pa.int64())
                where = pa.array(np.concatenate(at), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("bucket").take(rows), where, b.column("items").take(rows)], ["bucket", "at", "items"])
                sizes, at, start, waiting = [], [], i, 0


def occurrences(tids: DataFrame, places: DataFrame, most: int | None = None) -> DataFrame:
    """(source_id, items): the sources that the bits of ``tids`` stand for; of
    each row's the first ``most`` by id, if given."""
    found = tids.select("bucket", "width", "items", "bits").mapInArrow(lambda b: named(b, most), "bucket long, at int, items array<string>")
    who = places.where("bits IS NULL").select("bucket", "at", "source_id").hint("merge")  # a row for each source
    return found.join(who, ["bucket", "at"]).select("source_id", "items")


def told(tids: DataFrame, places: DataFrame) -> DataFrame:
    """``TIDS`` whose bits are those sources for which one of the items is told."""

    def run(batches):
        for b in batches:
            stored = []
            for x, w, marks in zip(b.column("bits").to_pylist(), b.column("width").to_pylist(), b.column("told").to_pylist()):
                stored.append(pack(positions(unpack([x], w)[0] & np.bitwise_or.reduce(unpack(marks, w))), w))
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("width"), b.column("items"), pa.array(stored, pa.binary())], ["bucket", "width", "items", "bits"])

    own = places.where("bits IS NOT NULL").select("bucket", F.col("items")[0].alias("item"), "told").hint("merge")
    each = tids.select("bucket", "width", "items", "bits", F.explode("items").alias("item")).join(own, ["bucket", "item"])
    each = each.groupBy("bucket", "width", "items").agg(F.first("bits").alias("bits"), F.collect_list("told").alias("told"))
    return each.mapInArrow(run, TIDS)


def spread(tids: DataFrame, places: DataFrame, kinds: DataFrame, sets: int) -> DataFrame:
    """(items, the columns of ``kinds``, n): sources of each set by what
    ``kinds`` (source_id and two columns) says of them. Bits are counted bucket
    by bucket, so no row is made for a source of a set; ``sets``, their number,
    and the number of kinds say in how many slices a bucket's sets come."""
    names = [c for c in kinds.columns if c != "source_id"]
    schema = StructType([f for f in tids.select("items").schema] + [kinds.schema[c] for c in names]).add("n", "long")
    different = min(BUCKET, kinds.agg(F.approx_count_distinct(F.struct(*names)).alias("n")).first()["n"])
    slices = max(1, -(-sets * different // PAIRS), -(-sets * BUCKET // (8 * BYTES)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = [right.column(c).combine_chunks().dictionary_encode() for c in names]
        first, second = [np.asarray(c.indices.fill_null(-1), np.int64) + 1 for c in codes]
        used, code = np.unique(first * (len(codes[1].dictionary) + 1) + second, return_inverse=True)
        width = max(left.column("width").to_pylist(), default=0)
        of = np.full(8 * width, -1)
        if left.num_rows:
            of[np.asarray(right.column("at"))] = code
        rows, kind, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, x in enumerate(left.column("bits").to_pylist()):
            found = of[positions(unpack([x], width)[0])]
            counts = np.bincount(found[found >= 0], minlength=len(used))
            kind.append(np.flatnonzero(counts))
            n.append(counts[kind[-1]])
            rows.append(np.full(len(kind[-1]), i))
        value = used[np.concatenate(kind)] if len(used) else np.empty(0, np.int64)
        parts = np.divmod(value, len(codes[1].dictionary) + 1)
        cells = [c.dictionary.take(pa.array(p - 1, pa.int64(), mask=p == 0)) for c, p in zip(codes, parts)]
        items = left.column("items").combine_chunks().take(pa.array(np.concatenate(rows)))
        return pa.table([items, *cells, pa.array(np.concatenate(n), pa.int64())], ["items", *names, "n"])

    who = places.where("bits IS NULL").select("bucket", "at", "source_id").hint("merge")  # a row for each source
    marks = who.join(kinds, "source_id").select("bucket", "at", *names)
    marks = marks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = tids.select(F.col("bucket").alias("own_bucket"), "width", "items", "bits", F.pmod(F.xxhash64("items"), F.lit(slices)).cast("int").alias("slice"))
    each = dealt.groupBy("own_bucket", "slice").cogroup(marks.groupBy("bucket", "slice")).applyInArrow(run, schema)
    return each.groupBy("items", *names).agg(F.sum("n").alias("n"))
