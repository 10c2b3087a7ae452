"""Bitmaps of sources against plain itemset counting."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.operators import bitsets, mining
from attesta.plans import queries
from attesta.sources import shared


def plain(baskets, least, most):
    by = {}
    for s, x in baskets:
        by.setdefault(s, set()).add(x)
    found = {}
    for items in by.values():
        for k in range(2, most + 1):
            for c in combinations(sorted(items), k):
                found.setdefault(c, set()).update([s for s, v in by.items() if v is items])
    return {c: s for c, s in found.items() if len(s) >= least}


@pytest.mark.parametrize("at", [[], [0], [63, 64], list(range(0, 512, 3)), [511]])
def test_bits_are_stored_both_ways(at):
    a = np.array(at, np.int64)
    stored = bitsets.pack(a, 64)
    assert len(stored) <= 65 and bitsets.positions(bitsets.unpack([stored], 64)[0]).tolist() == at


@pytest.mark.parametrize(("bucket", "pairs"), [(1 << 15, 4 << 20), (64, 4 << 20), (64, 8)])
def test_levels_and_sources(spark, monkeypatch, bucket, pairs):
    monkeypatch.setattr(bitsets, "BUCKET", bucket)
    monkeypatch.setattr(bitsets, "PAIRS", pairs)
    rng = random.Random(5)
    names = ["a", "b", "漢", "", *(f"x{i}" for i in range(8))]
    rows = {(s, x) for s in range(300) for x in names if rng.random() < (1.0 if s == 0 else 0.25)} | {(s, x) for s in range(0, 300, 3) for x in "ab"}
    df = spark.createDataFrame([*rows, (None, "a"), (1, None)], "source_id long, item string")
    levels, tids, places = mining.itemset_levels(df, 12, 4)
    want = plain(rows, 12, 4)
    assert {tuple(r["items"]): (r["size"], r.source_count) for r in levels.collect()} == {c: (len(c), len(s)) for c, s in want.items()}
    got = bitsets.occurrences(tids, places).groupBy("items").agg(F.collect_list("source_id").alias("s")).collect()
    assert {tuple(r["items"]): sorted(r.s) for r in got} == {c: sorted(s) for c, s in want.items()}
    assert (places.select("bucket").distinct().count() > 1) == (bucket == 64)


def test_no_frequent_items(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, item string")
    for d, least in ((df, 5), (df.where("false"), 1), (df, 1)):
        levels, tids, places = mining.itemset_levels(d, least)
        assert levels.count() == 0 == bitsets.occurrences(tids, places).count()


def test_bits_are_named_in_bounded_batches():
    full = bitsets.pack(np.arange(8192), 1024)
    b = pa.RecordBatch.from_arrays([pa.array([7] * 64), pa.array([1024] * 64, pa.int32()), pa.array([["a", str(i)] for i in range(64)]), pa.array([full] * 64)], ["bucket", "width", "items", "bits"])
    out = list(bitsets.named(iter([b]), None))
    assert sum(x.num_rows for x in out) == 64 * 8192 and max(x.num_rows for x in out) <= bitsets.ROWS + 8192
    assert [(r["at"], r["items"][1]) for x in bitsets.named(iter([b]), 2) for r in x.to_pylist()] == [(k, str(i)) for i in range(64) for k in range(2)]


def test_kinds_and_first_sources_without_a_row_for_each(spark):
    rng = random.Random(5)
    sets = {f"s{i:03d}": [x for x in "abcd" if rng.random() < 0.7] for i in range(300)}
    kinds = {s: (rng.choice(["x", "y", None]), rng.choice(["p", "q"])) for s in sets}
    rows = [(s, x, rng.random() < 0.1) for s, xs in sets.items() for x in xs]
    levels, tids, places = mining.itemset_levels(spark.createDataFrame(rows, "source_id string, item string, told boolean").repartition(3), 5, 3)
    k = spark.createDataFrame([(s, *v) for s, v in kinds.items()], "source_id string, tradition_id string, book_name string")
    got = {(tuple(r["items"]), r["tradition_id"], r["book_name"]): r["n"] for r in bitsets.spread(tids, places, k, 10).collect()}
    each = [t for n in (2, 3) for t in combinations("abcd", n)]
    assert got == Counter((t, *kinds[s]) for t in each for s, xs in sets.items() if set(t) <= set(xs))
    said = {(s, x) for s, x, told in rows if told}
    found = bitsets.occurrences(bitsets.told(tids, places), places).groupBy("items").agg(F.sort_array(F.collect_list("source_id")).alias("s")).collect()
    assert {tuple(r["items"]): r["s"] for r in found} == {t: sorted(s for s, xs in sets.items() if set(t) <= set(xs) and any((s, x) in said for x in t)) for t in each}
    few = bitsets.occurrences(tids, places, 3).groupBy("items").agg(F.sort_array(F.collect_list("source_id")).alias("s")).collect()
    assert {tuple(r["items"]): r["s"][:3] for r in few} == {t: sorted(s for s, xs in sets.items() if set(t) <= set(xs))[:3] for t in each}


def test_what_grows_with_the_sources_is_never_broadcast(spark, monkeypatch):
    """Tables of sources and large tables of parts pack into small files, by
    which the engine would send them to the driver and broadcast them."""
    rows = [(s, x) for s in range(200) for x in "abc"]
    levels, tids, places = mining.itemset_levels(spark.createDataFrame(rows, "source_id long, item string"), 5, 3)
    kinds = spark.range(200).select(F.col("id").alias("source_id"), F.lit("t").alias("tradition_id"), F.lit("b").alias("book_name"))
    monkeypatch.setattr(shared, "SMALL_ROWS", 100)
    parts = queries.part_observations(spark, "/root/testdata/sf0.001")
    for found in (bitsets.occurrences(tids, places, 3), bitsets.told(tids, places), bitsets.spread(tids, places, kinds, 4), parts):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    monkeypatch.setattr(shared, "SMALL_ROWS", 1000)
    assert "Broadcast" in queries.part_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
