"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import free_names

#: Key ranges into which each source is cut at least, so that no task sorts a whole one.
RANGES = 1024


def n_words(text: Column) -> Column:
    """Number of runs of anything but blanks and ASCII controls 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on id and seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating; together
    they get as much as all of them hold. No target is above ``most`` times its
    source's size; what is cut off goes to the others by weight. Sources are
    filled in order of size by weight, so those that are full come first and
    one running sum finds the level of the rest. One row per source is all
    that the windows here see.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1)
    w = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("all", F.sum("source_size").over(everything).cast("double"))
    w = w.withColumn(
        "level",
        (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
    )
    # the first source that its cap doesn't fill sets the level of all after it
    w = w.withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    w = w.withColumn("rest", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    share = F.col("weight") * F.coalesce(F.col("rest"), F.lit(float("inf")))
    return w.select("source", "source_size", F.when(F.col("cap") == 0, 0.0).otherwise(F.least("cap", share)).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ratings: DataFrame | None = None,
    unrated: float = 1.0, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix", ranges: int | None = None
) -> DataFrame:
    """``docs`` with size (words), source_size, target, times (how often the
    mix takes the document) and taken (words), or, where ``docs`` has such
    names, with what ``free_names`` makes of them; its own columns stay.

    Each document draws the exponential key ``-ln(u) / quality``; within its
    source, smaller keys come first. A target of e whole epochs and a rest
    takes each document e times, and once more those at the front whose words
    fill the rest; the document at the end of it is taken if more than half of
    it fits. ``ratings``: (id, quality), the greatest positive quality of an id
    counts; ids without one weigh ``unrated``.

    Null ids share one draw, null texts have size 0, null is a source of its
    own. Rows that repeat an id are documents of their own, of equal key,
    ordered by size. An empty table gives an empty one. Words of a text of any
    length are counted as a whole.

    A source is cut into ``ranges`` key ranges (by default RANGES, or one for
    every 100,000 rows of the table if those are more); sums of ranges, then
    sums inside each, make the running sum, so no task holds a whole source.
    The texts are not shuffled unless the result is asked for them.
    """
    ranges = ranges or max(RANGES, docs.count() // 100_000)
    name = free_names(docs.columns, ("size", "source_size", "target", "times", "taken"))
    kept = {f"__c{i}": c for i, c in enumerate(docs.columns)}  # flat, so that columns nobody asks for don't travel
    d = docs.select(
        *[F.col(f"`{c}`").alias(k) for k, c in kept.items()], F.col(f"`{id_col}`").alias("__id"),
        F.col(f"`{source_col}`").alias("__source"), n_words(F.col(f"`{text_col}`")).alias("__size"),
        uniform(F.col(f"`{id_col}`"), seed).alias("__u")
    )
    quality = F.lit(float(unrated))
    if ratings is not None:  # after the count, so that texts nobody asks for don't travel
        best = ratings.where("id IS NOT NULL AND quality > 0").groupBy(F.col("id").alias("__r_id")).agg(F.max("quality").cast("double").alias("__quality"))
        d = d.join(best, F.col("__id") == F.col("__r_id"), "left")
        quality = F.coalesce(F.col("__quality"), quality)
    d = d.withColumn("__key", -F.log(F.col("__u")) / quality)
    d = d.withColumn("__range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("__key"))) * ranges)).cast("int"))
    parts = d.groupBy(F.col("__source").alias("source"), F.col("__range").alias("range")).agg(F.sum("__size").alias("part"))
    sums = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    goal = targets(sums, weights, most)
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0)))
    plan = plan.join(goal, plan["source"].eqNullSafe(goal["source"])).select(
        plan["source"].alias("__p_source"), F.col("range").alias("__p_range"), F.col("ahead").alias("__ahead"),
        F.col("source_size").alias("__total"), F.col("target").alias("__target")
    )
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__within", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    d = d.join(plan, F.col("__source").eqNullSafe(F.col("__p_source")) & (F.col("__range") == F.col("__p_range")))
    size, total, target = F.col("__size"), F.col("__total"), F.col("__target")
    epochs = F.floor(target / total)
    once = F.col("__ahead") + F.col("__within") + size / 2.0 <= target - epochs * total
    times = F.when(size > 0, epochs + F.when(once, 1).otherwise(0)).otherwise(0)
    out = {"size": size, "source_size": total, "target": target, "times": times.cast("int"), "taken": (size * times).cast("long")}
    return d.select(*[F.col(k).alias(c) for k, c in kept.items()], *[x.alias(name[k]) for k, x in out.items()])
