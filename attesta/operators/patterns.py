"""Candidate patterns: frequent itemsets of the sources' observations with
measures, filters, sources and evidence."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import normal_item
from ..sources.shared import beside, written
from . import bitsets, mining
from .extract import number

#: What certain observations suggest (fixed values).
HINTS = [
    (("pain_quality:cold", "relieving_factor:warmth_relieves"), ("寒湿痹阻", "寒凝经脉", "阳虚寒凝")),
    (("course:chronic", "symptom:waist_knee_soreness"), ("肾虚证",)),
    (("pain_quality:stabbing_fixed", "aggravating_factor:night_worse"), ("瘀血阻络",)),
    (("tongue:yellow_greasy",), ("湿热下注",)),
]
#: Settings a configuration leaves out (fixed values).
DEFAULTS = {
    "max_size": 3, "min_support": 0.03, "min_lift": 1.5, "min_pmi": 0.5, "min_source_count": 3, "min_tradition_count": 1,
    "fisher_p_max": None, "fisher_test": True, "max_source_ids_per_pattern": 100, "top_k_patterns": 0
}
#: Sources whose evidence a pattern shows.
EVIDENCE = 5


def items_of(observations: DataFrame) -> DataFrame:
    """``observations`` with the normal form of their key as ``item``. Only
    different keys pass through Python; they are written, so that the engine
    knows how many there are."""
    keys = written(observations.select("observation_key").distinct().select("observation_key", normal_item(F.col("observation_key")).alias("item")), "keys")
    return observations.join(beside(keys), "observation_key").where("item <> ''")


def hints(items, rules=HINTS):
    """Suggestions for a list of items, in the order of the rules."""
    joined = F.array_join(items, " ")
    found = [
        F.when(
            reduce(lambda a, b: a | b, [F.contains(joined, F.lit(n)) for n in needles]), F.array(*[F.lit(s) for s in said])
        ).otherwise(F.array().cast("array<string>")) for needles,
        said in rules
    ]
    return F.array_distinct(F.flatten(F.array(*found)))


def mine_patterns(observations: DataFrame, sources: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The patterns of ``patterns_and_sources`` alone."""
    return patterns_and_sources(observations, sources, config)[0]


def patterns_and_sources(observations: DataFrame, sources: DataFrame, config: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Patterns in order, with ids; and (pattern_id, source_id) of all their
    sources, of which a pattern's own row names the first
    max_source_ids_per_pattern and counts all.

    ``observations``: source_id, observation_key, mapping_status,
    evidence_text, seq; those of unknown sources are left out. ``sources``:
    source_id, book_name, tradition_id. ``config``: as DEFAULTS; max_size 0 is
    the greatest there is; without ``fisher_test`` pairs have no exact p. N counts all sources, also those without
    observations; below 30 the support alone decides on a pattern's sources,
    traditions aren't asked for, and patterns are exploratory. Every set with the
    support is measured: max_pair_candidates and max_join_candidates, which
    older configurations hold, drop none, and all patterns stay unless
    top_k_patterns asks for the first ones. Lift and pmi filter the result,
    not the levels. Order: source_count, lift, pmi, p, then size and items.
    """
    c = {**DEFAULTS, **{k: v for k, v in config.items() if v is not None}}
    known = sources.select("source_id", "book_name", "tradition_id", F.monotonically_increasing_id().alias("seq"))
    meta = known.groupBy("source_id").agg(  # of a repeated id the last
        F.max_by("book_name", "seq").alias("book_name"), F.max_by("tradition_id", "seq").alias("tradition_id")
    )
    meta = written(meta, "sources")
    n = meta.count()
    least, exploratory = mining.min_counts(n, float(c["min_support"]), int(c["min_source_count"]))
    production = max(int(c["min_source_count"]), mining.min_counts(n, float(c["min_support"]), 0)[0])
    top, cap = int(c["top_k_patterns"]), max(0, int(c["max_source_ids_per_pattern"]))
    held = observations.join(meta.select("source_id").hint("merge"), "source_id", "left_semi").select(
        "source_id", "observation_key", F.coalesce(F.nullif("mapping_status", F.lit("")), F.lit("unknown")).alias("mapping_status"),
        "evidence_text", "seq"
    )
    known = written(items_of(written(held, "observations")).drop("observation_key"), "items")
    told = F.max(F.coalesce(F.col("evidence_text") != "", F.lit(False)))
    baskets = written(known.groupBy("source_id", "item").agg(told.alias("told")), "baskets")
    singles = beside(written(mining.item_counts(baskets), "singles"))
    levels, tids, places = mining.itemset_levels(baskets, least, int(c["max_size"]))
    m = mining.pattern_metrics(levels, singles, n)
    two = F.col("size") == 2
    pair = [F.when(two, F.element_at("items", k)).alias(f"i{k}") for k in (1, 2)]
    m = m.select("*", *pair)
    for k in (1, 2):
        m = m.join(singles.select(F.col("item").alias(f"i{k}"), F.col("n").alias(f"n{k}")), f"i{k}", "left")
    p = mining.fisher_greater(*[F.col(x).cast("double") for x in ("source_count", "n1", "n2")], F.lit(float(n)))
    m = m.withColumn("fisher_p", F.when(two, p) if c["fisher_test"] else F.lit(None).cast("double"))
    m = m.where(mining.passes(float(c["min_lift"]), float(c["min_pmi"]), c["fisher_p_max"], F.col("fisher_p"))).drop("i1", "i2", "n1", "n2")
    m = written(m, "measured")
    many = m.count()
    own = written(tids.join(beside(m.select("items"), many), "items", "left_semi"), "measured-bitmaps")
    of = written(bitsets.spread(own, places, meta, many), "spread")
    traditions = of.groupBy("items", "tradition_id").agg(F.sum("n").alias("n"))
    spread = traditions.groupBy("items").agg(
        F.count("*").alias("tradition_count"), F.sort_array(F.collect_list("tradition_id")).alias("tradition_ids"), F.sum("n").alias("t"),
        F.sum(F.col("n") * F.log("n")).alias("nl")
    )
    entropy = F.round(F.when(F.col("tradition_count") <= 1, 0.0).otherwise((F.log("t") - F.col("nl") / F.col("t")) / F.log("tradition_count")), 6)
    m = m.join(spread.withColumn("tradition_entropy", entropy).drop("t", "nl"), "items").where(
        F.col("tradition_count") >= (1 if exploratory else int(c["min_tradition_count"]))
    )
    m = m.withColumn("rank_p", -F.coalesce("fisher_p", F.lit(0.0)))
    order = [F.desc("source_count"), F.desc("lift"), F.desc("pmi"), F.desc("rank_p"), F.asc("size"), F.asc("items")]
    m = m.orderBy(*order).limit(top) if top > 0 else m
    m = written(number(m, order, "pattern_id", "PATTERN").drop("rank_p"), "patterns")
    named = beside(m.select("items", "pattern_id"), many)
    books = of.join(named, "items").select("pattern_id", "book_name").distinct().groupBy("pattern_id").agg(
        F.count("*").alias("book_count"), F.sort_array(F.collect_list("book_name")).alias("book_names")
    )
    own = own.join(named.select("items"), "items", "left_semi")

    def first(bits: DataFrame, most: int) -> DataFrame:  # each bucket's first ones hold the first of all
        found = bitsets.occurrences(bits, places, most).join(named, "items")
        return found.withColumn("place", F.row_number().over(Window.partitionBy("pattern_id").orderBy("source_id"))).where(F.col("place") <= most)

    ids = first(own, cap).groupBy("pattern_id").agg(F.sort_array(F.collect_list("source_id")).alias("source_ids"))
    shown = first(bitsets.told(own, places), EVIDENCE).select("pattern_id", "source_id", F.posexplode("items").alias("at", "item"))
    said = shown.join(known.where("evidence_text <> ''"), ["source_id", "item"])
    evidence = mining.representative_evidence(
        said.select(F.col("pattern_id").alias("pattern"), "source_id", F.struct("at", "seq").alias("seq"), F.col("evidence_text").alias("evidence")), EVIDENCE
    )
    status = known.groupBy("item", "mapping_status").agg(F.count("*").alias("n")).groupBy("item").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("mapping_status", "n")))).alias("counts")
    )
    summary = m.select("pattern_id", F.explode("items").alias("item")).join(status, "item").groupBy("pattern_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", F.map_entries("counts").alias("c"))))).alias("s")
    )
    summary = summary.select("pattern_id", F.transform_values("s", lambda _, v: F.map_from_entries(v)).alias("mapping_status_summary"))
    out = m.join(books, "pattern_id").join(ids, "pattern_id", "left").join(
        evidence.select(F.col("pattern").alias("pattern_id"), F.col("evidence").alias("representative_evidence")), "pattern_id", "left"
    ).join(summary, "pattern_id")
    none = F.array().cast("array<string>")
    note = "exploratory_only; lift/PMI unreliable for N<30" if exploratory else "confirmatory_filtering"
    shown = F.coalesce(F.size("source_ids"), F.lit(0))
    complete = F.when(
        F.col("source_count") > F.greatest(shown, F.lit(0)),
        F.concat(F.lit("source_ids_truncated_to="), F.greatest(shown, F.lit(0)).cast("string"))
    ).otherwise("source_ids_complete")
    text = F.concat(
        F.col("source_count").cast("string"),
        F.lit(f"/{n} sources; {note}; effective_min_source_count={least}; production_min_source_count={production}; {'fisher_available' if c['fisher_test'] else 'fisher_unavailable_optional_dependency'}; "),
        complete
    )
    out = out.select(
        "pattern_id", "items", "size", *[
            F.round(x, 6).alias(x) for x in ("support", "confidence", "lift", "pmi", "jaccard")
        ], F.round("fisher_p", 12).alias("fisher_p"), "source_count", "book_count", "tradition_count", F.round(F.col("book_count") / F.greatest(F.lit(1), F.col("source_count")), 6).alias("source_diversity"), "tradition_entropy",
        F.coalesce("source_ids", none).alias("source_ids"), "book_names", "tradition_ids", F.coalesce("representative_evidence", none).alias("representative_evidence"), hints(F.col("items")).alias("possible_interpretation"), text.alias("source_count_summary"), "mapping_status_summary", F.lit("candidate_pattern").alias("status"), F.lit(
            "exploratory_only" if exploratory else "pending"
        ).alias("review_status"),
    )
    return out, bitsets.occurrences(own, places).join(named, "items").select("pattern_id", "source_id")
