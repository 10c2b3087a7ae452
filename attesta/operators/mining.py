"""Frequent itemsets over baskets, level by level, and their measures."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import beside, drop, written
from . import bitsets


def min_counts(n: int, min_support: float, configured: int) -> tuple[int, bool]:
    """(fewest sources of a pattern, whether the sample is small)."""
    adaptive = max(1, math.ceil(n * min_support))
    return (adaptive, True) if n < 30 else (max(configured, adaptive), False)


def item_counts(baskets: DataFrame) -> DataFrame:
    """Sources of each item; ``baskets`` holds (source_id, item), distinct."""
    return baskets.groupBy("item").agg(F.count("*").alias("n"))


def itemset_levels(baskets: DataFrame, min_count: int, max_size: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, size, source_count) of all itemsets of 2 to ``max_size`` items
    (12 at most; 0: 12) in at least ``min_count`` sources; the bitmaps of their
    sources, and the places that ``bitsets.occurrences`` needs to name these.
    Support alone prunes, and no set that has it is left out. ``baskets`` may say by ``told`` which of its rows
    ``bitsets.told`` keeps; without it, it keeps all.

    Infrequent items leave the baskets first. A level meets the bitmaps of
    frequent sets that share all but their last item, bucket by bucket; counts
    are sums over the buckets. Its bitmaps are written once to the shared
    folder, so plans don't grow.
    """
    size, most = 1, 12 if max_size <= 0 else min(max(2, max_size), 12)
    singles = item_counts(baskets).where((F.col("n") >= min_count) & F.col("item").isNotNull())
    singles = written(singles, "frequent-items")
    different = singles.count()
    told = F.col("told") if "told" in baskets.columns else F.lit(True)
    dealt = baskets.join(beside(singles.select("item"), different), "item").select("source_id", "item", told.alias("told"))
    places = written(bitsets.place(dealt, different), "places")
    own = places.where("bits IS NOT NULL").select("bucket", "width", "items", "bits")
    levels, found = [own.limit(0).select("items", F.lit(2).alias("size"), F.lit(0).cast("long").alias("source_count"))], [own.limit(0)]
    while size < most:
        size += 1
        met = written(bitsets.meet(own, size, different), "bitmaps")
        counts = met.groupBy("items").agg(F.sum("n").alias("source_count")).where(F.col("source_count") >= min_count)
        counts = written(counts, "level")
        many = counts.count()
        if not many:
            break
        own = written(met.drop("n").join(beside(counts.select("items"), many), "items", "left_semi").select(*own.columns), "bitmaps")
        drop(met)
        levels.append(counts.select("items", F.lit(size).alias("size"), "source_count"))
        found.append(own)
    return reduce(DataFrame.union, levels), reduce(DataFrame.union, found), places


def _candidates(counts: DataFrame, size: int) -> DataFrame:
    """The sets of ``size`` items all of whose parts one item shorter are in ``counts``."""
    sets, head, last = counts.select("items"), F.slice("items", 1, size - 2), F.element_at("items", -1)
    pairs = sets.select(head.alias("head"), last.alias("a")).join(sets.select(head.alias("head"), last.alias("b")), "head").where("a < b")
    pairs = pairs.select(F.concat("head", F.array("a", "b")).alias("items"))
    without = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.lit(size))))
    parts = pairs.select("items", F.explode(without).alias("part"))
    return parts.join(sets.toDF("part"), "part").groupBy("items").agg(F.count("*").alias("k")).where(F.col("k") == size).select("items")


def frequent_itemsets(baskets: DataFrame, min_count: int, max_size: int = 12, pair_cap: int = 0, join_cap: int = 0) -> DataFrame:
    """The itemsets of ``itemset_levels`` alone, all of them unless the caller
    asks for the ``foremost``."""
    levels = itemset_levels(baskets, min_count, max_size)[0]
    return foremost(levels, item_counts(baskets), pair_cap, join_cap) if pair_cap or join_cap else levels


def foremost(levels: DataFrame, singles: DataFrame, pair_cap: int = 0, join_cap: int = 0) -> DataFrame:
    """Of all itemsets in ``levels``, for a first look at them, ``pair_cap``
    pairs (0: all), those whose rarer item is most frequent, ties by items, and
    of each later size those among the first ``join_cap`` (0: all) sets by
    items whose parts all stay."""
    pairs = levels.where("size = 2")
    if pair_cap:
        rarer = pairs.select(
            "*", F.col("items")[0].alias("x"), F.col("items")[1].alias("y")
        ).join(singles.toDF("x", "nx"), "x").join(singles.toDF("y", "ny"), "y")
        pairs = rarer.orderBy(F.desc(F.least("nx", "ny")), "items").limit(pair_cap).select(*levels.columns)
    found, size = [written(pairs, "level")], 2
    while found[-1].limit(1).count():
        size += 1
        sets = _candidates(found[-1], size)
        sets = sets.orderBy("items").limit(join_cap) if join_cap else sets
        found.append(written(levels.where(F.col("size") == size).join(sets, "items", "left_semi"), "level"))
    return reduce(DataFrame.union, found)


def pattern_metrics(patterns: DataFrame, singles: DataFrame, n: int) -> DataFrame:
    """Adds support, lift, pmi, confidence and jaccard, unrounded."""
    each = patterns.select("items", "size", "source_count", F.posexplode("items").alias("at", "item")).join(singles, "item")
    g = each.groupBy("items", "size", "source_count").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("s"))
    chance = F.aggregate("s", F.lit(1.0), lambda acc, s: acc * F.greatest(s["n"] / F.lit(float(n)), F.lit(1e-12)))
    least, total = F.array_min(F.transform("s", lambda s: s["n"])), F.aggregate("s", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    c = F.col("source_count")
    g = g.withColumns({"support": c / F.lit(float(n)), "chance": chance, "least": least, "total": total})
    g = g.withColumn("lift", F.col("support") / F.col("chance"))
    return g.select(
        "items", "size", "source_count", "support", "lift", F.log2("lift").alias("pmi"),
        (c / F.greatest(F.lit(1), F.col("least"))).alias("confidence"), (c / F.greatest(F.lit(1), F.col("total") - c)).alias("jaccard")
    )


def passes(min_lift: float, min_pmi: float, p_max: float | None = None, p: Column | None = None) -> Column:
    """The statistical filter, on unrounded measures; a null p passes."""
    ok = (F.col("lift") >= min_lift) & (F.col("pmi") >= min_pmi)
    return ok if p is None or p_max is None else ok & (p.isNull() | (p <= p_max))


def upper_tail(both: float, a: float, b: float, n: float) -> float:
    """Chance of ``both`` or more in common between ``a`` and ``b`` of ``n``.
    Terms follow from one another and end where they no longer add."""
    log = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    i, last = max(both, a + b - n), min(a, b)
    term = math.exp(log(a, i) + log(n - a, b - i) - log(n, b)) if i <= last else 0.0
    total = 0.0
    while i <= last:
        total += term
        ratio = (a - i) * (b - i) / ((i + 1) * (n - a - b + i + 1))
        if ratio < 1 and term * ratio <= total * 1e-17 * (1 - ratio):
            break
        term, i = term * ratio, i + 1
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def fisher_greater(both: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """One-sided exact p of a pair: the upper tail of the hypergeometric; null
    where a count is."""
    return pd.Series([None if any(v != v for v in x) else upper_tail(*x) for x in zip(both, a, b, n)], dtype="float64")


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entropy of ``value`` per key, as a share of the greatest possible; one
    value: 0."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("nl"))
    return t.select(
        *keys, F.col("k").alias("distinct_values"),
        F.round(F.when(F.col("k") <= 1, 0.0).otherwise((F.log("t") - F.col("nl") / F.col("t")) / F.log("k")), 6).alias("entropy")
    )


def representative_evidence(occurrences: DataFrame, most: int = 5) -> DataFrame:
    """Per pattern the first sources by id with their distinct evidence, as
    ``source: e1；e2``. ``occurrences``: (pattern, source_id, seq, evidence).

    Sources are ranked before anything is collected: each task keeps its own
    first ones, so neither the shuffle nor a row grows with a pattern's sources."""
    first = occurrences.withColumn("place", F.dense_rank().over(Window.partitionBy("pattern").orderBy("source_id"))).where(F.col("place") <= most)
    per = first.groupBy("pattern", "source_id").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "evidence"))), lambda s: s["evidence"])).alias("e")
    )
    per = per.select(
        "pattern",
        F.struct("source_id", F.concat(F.col("source_id").cast("string"), F.lit(": "), F.array_join("e", "；")).alias("text")).alias("s")
    )
    ranked = per.groupBy("pattern").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return ranked.select("pattern", F.transform("s", lambda s: s["text"]).alias("evidence"))
