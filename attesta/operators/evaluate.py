"""Evaluation against expert answers; each metric is one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import split_set
from .infer import last_of

#: Gold tables and their columns (fixed names).
GOLD = {
    "expert_memberships.csv": ("source_id", "standard_observation", "variable", "fuzzy_set", "expert_membership"),
    "expert_inference.csv": ("source_id", "consequent_entity", "expert_membership"),
    "expected_interpretations.csv": ("source_id", "expected_consequents"),
    "modern_mappings.csv": ("entity_name", "expected_modern_mapping"),
    "conditional_relations.csv": ("condition", "model_membership", "expert_membership"),
    "chain_paths.csv": ("case_id", "model_path", "expert_path", "path_overlap"),
}


def metric(df: DataFrame, name: str, value: Column, formula: str) -> DataFrame:
    """metric, value (in [0, 1], rounded), n, status."""
    v = df.agg(value.alias("v"), F.count("*").alias("n"))
    good = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v"))), 6)
    return v.select(
        F.lit(name).alias("metric"), good.alias("value"), "n",
        F.when(F.col("n") > 0, "computed").otherwise("needs_gold_standard").alias("status"), F.lit(formula).alias("formula")
    )


def agreement(model: DataFrame, gold: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1 minus the mean distance of model and expert where both answer."""
    return metric(model.join(gold, keys), name, 1 - F.avg(F.abs(F.col("membership") - F.col("expert"))), "1 - mean|model - expert|")


def overlap_with(predicted: DataFrame, gold: DataFrame, key: str, name: str) -> DataFrame:
    """Mean share of the expected values that were predicted; empty
    expectations are left out, missing predictions score 0."""
    both = gold.where(F.size("expected") > 0).join(predicted, key, "left")
    share = F.size(F.array_intersect(F.coalesce("predicted", F.array().cast("array<string>")), F.col("expected"))) / F.size("expected")
    return metric(both, name, F.avg(share), "mean |model and expected| / |expected|")


def needs_gold(spark: SparkSession, name: str, file: str, why: str) -> DataFrame:
    """The row of a metric whose gold table is absent."""
    return spark.createDataFrame(
        [(name, None, 0, "needs_gold_standard", why)], "metric string, value double, n long, status string, formula string"
    ).withColumn("required_gold_file", F.lit(file))


def mapping_overlap(entities: DataFrame, gold: DataFrame) -> DataFrame:
    """SMB: mean share of the expected modern mappings that an entity has.
    Unknown entities score 0, empty expectations are left out; of entities
    listed twice the last counts."""
    last = entities.withColumn("__seq", F.monotonically_increasing_id()).groupBy("entity_name").agg(F.max_by("modern_mapping", "__seq").alias("m"))
    predicted = last.select("entity_name", split_set(F.col("m")).alias("predicted"))
    return overlap_with(predicted, gold.select("entity_name", split_set(F.col("expected_modern_mapping")).alias("expected")), "entity_name", "SMB")


def mapping_coverage(entities: DataFrame) -> DataFrame:
    """What stands for SMB without gold: the share of entities with a mapping."""
    has = F.coalesce(F.trim("modern_mapping"), F.lit("")) != ""
    d = metric(entities, "SMB-coverage-proxy", F.count(F.when(has, 1)) / F.greatest(F.lit(1), F.count("*")), "entities with a modern mapping / entities")
    return d.withColumn("status", F.lit("proxy"))


def chain_overlap(gold: DataFrame) -> DataFrame:
    """FIA-chain: mean path overlap, nulls left out."""
    return metric(gold.where("path_overlap IS NOT NULL"), "FIA-chain", F.avg("path_overlap"), "mean path overlap")


def gold_templates(spark: SparkSession) -> DataFrame:
    """File and columns of each gold table."""
    return spark.createDataFrame([(f, ",".join(c)) for f, c in GOLD.items()], "file_name string, columns string")


def evaluation(memberships: DataFrame, results: DataFrame, entities: DataFrame, gold: dict[str, DataFrame]) -> DataFrame:
    """All metrics, in their fixed order. ``gold``: tables by file name; one
    that is absent, empty or lacks a column gives ``needs_gold_standard``.
    Of model rows with one key the last (by ``seq``, by rule) counts."""
    spark = memberships.sparkSession
    fired = results.where("status = 'fired'")

    def of(file: str, columns: tuple[str, ...], name: str, why: str, make) -> DataFrame:
        g = gold.get(file)
        if g is None or not set(columns) <= set(g.columns):
            return needs_gold(spark, name, file, why)
        d = make(g).withColumn("required_gold_file", F.when(F.col("n") == 0, F.lit(file)).otherwise(""))
        return d.withColumn("value", F.when(F.col("n") > 0, F.col("value")))

    keys = ["source_id", "standard_observation", "variable", "fuzzy_set"]
    expert = F.col("expert_membership").cast("double").alias("expert")
    parts = [
        of(
            "expert_memberships.csv", (*keys, "expert_membership"), "FCR", "needs expert memberships",
            lambda g: agreement(last_of(memberships.select(*keys, "seq", "membership"), keys, "seq"), g.select(*keys, expert), keys, "FCR")
        ),
        of(
            "expert_inference.csv", ("source_id", "consequent_entity", "expert_membership"), "FIA-local", "needs expert inferences",
            lambda g: agreement(
                last_of(
                    fired.select("source_id", "consequent_entity", "rule_id", F.col("activation").alias("membership")),
                    ["source_id", "consequent_entity"], "rule_id"
                ),
                g.select("source_id", "consequent_entity", expert), ["source_id", "consequent_entity"], "FIA-local"
            )
        ),
        of(
            "expected_interpretations.csv", ("source_id", "expected_consequents"), "MIC", "needs expected interpretations",
            lambda g: overlap_with(
                fired.groupBy("source_id").agg(F.collect_set("consequent_entity").alias("predicted")),
                g.select("source_id", split_set(F.col("expected_consequents")).alias("expected")), "source_id", "MIC"
            )
        ),
        of(
            "modern_mappings.csv", ("entity_name", "expected_modern_mapping"), "SMB", "", lambda g: mapping_overlap(entities, g)
        ) if gold.get("modern_mappings.csv") is not None else mapping_coverage(entities).withColumn("required_gold_file", F.lit("")),
        of(
            "conditional_relations.csv", ("model_membership", "expert_membership"), "CRP",
            "needs expert strengths of relations under conditions",
            lambda g: metric(
                g, "CRP", 1 - F.avg(F.abs(F.col("model_membership").cast("double") - F.col("expert_membership").cast("double"))),
                "1 - mean|model - expert|"
            )
        ),
        of("chain_paths.csv", ("path_overlap",), "FIA-chain", "needs paths of model and expert", chain_overlap),
        interpretations(fired).select(
            F.lit("multi_interpretation_count_proxy").alias("metric"), F.coalesce("value", F.lit(0.0)).alias("value"), "n",
            F.lit("proxy").alias("status"), F.lit("mean fired consequents per source").alias("formula"),
            F.lit("").alias("required_gold_file")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def interpretations(fired: DataFrame) -> DataFrame:
    """Mean number of different consequents of a source that has any."""
    per = fired.groupBy("source_id").agg(F.countDistinct("consequent_entity").alias("k"))
    return per.agg(F.round(F.avg("k"), 6).alias("value"), F.count("*").alias("n"))
