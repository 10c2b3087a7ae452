"""From fired rules to sources, traditions and the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import small


def by_source(fired: DataFrame, rules: DataFrame, meta: DataFrame, gamma: float = 0.5) -> DataFrame:
    """Quality-weighted mean activation of each source and consequent. A rule's
    quality is the greatest of its weight, its acceptance rate and 0.1 (0.5 for
    an unknown rule; of a rule listed twice the last row counts); n rows are
    discounted by n to the power -gamma. ``meta``: one row per source."""
    q = rules.select(
        "rule_id", F.greatest("rule_weight", F.coalesce("expert_acceptance_rate", F.lit(0.0)), F.lit(0.1)).alias("q"),
        F.monotonically_increasing_id().alias("seq")
    )
    q = q.groupBy("rule_id").agg(F.max_by("q", "seq").alias("q"))
    d = fired.join(small(q), "rule_id", "left").withColumn("q", F.coalesce("q", F.lit(0.5)))
    g = d.groupBy("source_id", "consequent_entity").agg(
        F.count("*").alias("n_rules"), F.sum("q").alias("sq"), F.sum(F.col("q") * F.col("activation")).alias("sqa")
    )
    discount = F.pow(F.col("n_rules").cast("double"), F.lit(-float(gamma)))
    g = g.select(
        "source_id", "consequent_entity", "n_rules", discount.alias("discount"), (F.col("sq") * discount).alias("total_weight"),
        F.round(F.when(F.col("sq") == 0, 0.0).otherwise(F.col("sqa") / F.col("sq")), 6).alias("membership")
    )
    return g.join(meta, "source_id")


def by_tradition(sources: DataFrame) -> DataFrame:
    """Mean of the sources' memberships weighted by their quality_weight."""
    q = F.sum("quality_weight")
    return sources.groupBy("tradition_id", "consequent_entity").agg(
        F.round(
            F.when(q == 0, 0.0).otherwise(F.sum(F.col("quality_weight") * F.col("membership")) / q), 6
        ).alias("membership"), F.sum("n_rules").alias("evidence_count"), F.count("*").alias("source_count")
    )


def noisy_or(traditions: DataFrame, deltas: DataFrame, default: float = 1.0) -> DataFrame:
    """1 minus the product of 1 - delta * membership over the traditions."""
    d = traditions.join(small(deltas), "tradition_id", "left").withColumn("delta", F.coalesce("delta", F.lit(float(default))))
    mu = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.product(1 - F.col("delta") * F.col("membership"))))
    ordered = F.sort_array(F.collect_list(F.struct("tradition_id", "delta")))
    return d.groupBy("consequent_entity").agg(
        F.round(mu, 6).alias("membership"), F.sum("evidence_count").alias("evidence_count"), F.count("*").alias("tradition_count"),
        F.transform(ordered, lambda s: s["delta"]).alias("delta_values")
    )


def all_levels(sources: DataFrame, traditions: DataFrame, whole: DataFrame) -> DataFrame:
    """One table of the three levels; columns a level lacks are null."""
    tag = lambda d, n: d.withColumn("level", F.lit(n))
    return tag(sources, "source").unionByName(
        tag(traditions, "tradition"), allowMissingColumns=True
    ).unionByName(tag(whole, "global"), allowMissingColumns=True)


def stratify(df: DataFrame, scalars: list[str], arrays: list[str]) -> DataFrame:
    """Rows per value of each dimension; arrays count each element; blank is
    ``uncertain``. One explode and one aggregation for all dimensions."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("dim"), F.lit(c).alias("dimension"), F.array(F.col(c).cast("string")).alias("v")) for i, c in enumerate(scalars)],
        *[F.struct(F.lit(len(scalars) + i).alias("dim"), F.lit(c).alias("dimension"), F.col(c).cast("array<string>").alias("v")) for i, c in enumerate(arrays)]
    )
    long = df.select(F.explode(cells).alias("c")).select("c.dim", "c.dimension", F.explode("c.v").alias("value"))
    value = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.lit("uncertain"))
    return long.groupBy("dim", "dimension", value.alias("value")).agg(F.count("*").alias("n")).drop("dim")
