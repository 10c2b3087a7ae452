"""Validation findings and the verdict. A finding is a row of (item, severity,
code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .infer import ACTIVE
from .membership import coverage


#: Sections that a configuration must have, and metadata that sources should (fixed names).
SECTIONS = (
    "membership_calculation", "mapping_policy", "uncertainty_propagation", "candidate_pattern_filter", "fuzzy_sets", "observation_mapping",
    "linguistic_values", "seed_rules", "entities"
)
METADATA = ["book_name", "chapter_title", "dynasty", "author", "text_type", "topic_hint", "tradition_id", "text_family", "citation_family"]


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def uncertain_metadata(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field) for each field that is blank or ``uncertain``."""
    cells = F.array(*[F.when(F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("uncertain")) == "uncertain", F.lit(c)) for c in fields])
    return df.select(F.col(key).alias("id"), F.explode(F.array_compact(cells)).alias("field"))


def finding(df: DataFrame, item: Column, severity: str, code: str) -> DataFrame:
    return df.select(item.cast("string").alias("item"), F.lit(severity).alias("severity"), F.lit(code).alias("code"))


def union(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, findings)


def fewer_than(df: DataFrame, least: int, severity: str, code: str) -> DataFrame:
    """One finding if ``df`` has fewer rows than ``least``; no more are read."""
    return finding(df.select(F.lit(1)).limit(least).agg(F.count("*").alias("n")).where(F.col("n") < least), F.lit("all"), severity, code)


def source_findings(sources: DataFrame, key: str, texts: list[str], uncertain: DataFrame) -> DataFrame:
    """No sources, ids that repeat and sources whose texts are all null or empty
    are errors; ``uncertain`` (of ``uncertain_metadata``) are warnings."""
    blank = reduce(Column.__and__, [F.coalesce(F.col(c), F.lit("")) == "" for c in texts])
    return union(
        fewer_than(sources, 1, "error", "no_sources"),
        finding(duplicates(sources, key), F.col("id"), "error", "duplicate_source_id"),
        finding(sources.where(blank), F.col(key), "error", "missing_text"),
        finding(uncertain, F.col("id"), "warning", "uncertain_metadata"),
    )


def coverage_findings(observations: DataFrame, memberships: DataFrame, order: list[str], key: str = "observation_id", most: int = 20) -> DataFrame:
    """No observations: an error. Less than 0.70 of them with a membership, and
    the first ``most`` unmapped ones of high confidence: warnings."""
    share = coverage(observations, memberships, key).where("observations > 0 AND mapped / observations < 0.70")
    unmapped = observations.where("coalesce(mapping_status, '') <> 'mapped' AND extraction_confidence >= 0.85")
    return union(
        fewer_than(observations, 1, "error", "no_observations"),
        finding(share, F.lit("membership"), "warning", "low_membership_coverage"),
        finding(unmapped.orderBy(*order).limit(most), F.col(key), "warning", "high_confidence_unmapped_observation"),
    )


def sample_findings(sources: DataFrame) -> DataFrame:
    return fewer_than(sources, 30, "warning", "exploratory_only_small_sample")


def rule_errors(rules: DataFrame) -> DataFrame:
    return union(
        fewer_than(rules, 1, "error", "no_rules"),
        finding(rules.where(F.coalesce(F.size("antecedents"), F.lit(0)) <= 0), F.col("rule_id"), "error", "rule_without_antecedents"),
        finding(rules.where(F.coalesce("consequent_entity", F.lit("")) == ""), F.col("rule_id"), "error", "rule_without_consequent"),
    )


def inactive_rules(rules: DataFrame) -> DataFrame:
    return finding(rules.where(~F.coalesce("review_status", F.lit("")).isin(ACTIVE)), F.col("rule_id"), "warning", "inactive_rule_status")


def config_findings(spark: SparkSession, config: dict) -> DataFrame:
    """Sections that a configuration lacks, and rules whose antecedents name a
    fuzzy set it doesn't have: errors."""
    sets = config.get("fuzzy_sets", {})
    rows = [(s, "error", "missing_config_section") for s in SECTIONS if s not in config]
    rows += [(str(r.get("rule_id", "unknown_rule")), "error", "rule_references_missing_fuzzy_set") for r in config.get("seed_rules", []) for a in r.get("antecedents", []) if a.get("fuzzy_set") not in sets.get(a.get("variable"), {})]
    return spark.createDataFrame(rows, "item string, severity string, code string")


def ignored_priors(spark: SparkSession, config: dict) -> DataFrame:
    """Calibrated mappings whose shape keeps the prior from being read."""
    rows = [
        (f"{t}.{v}", "info", "calibrated_prior_ignored") for t, e in config.get("linguistic_values", {}).items() for v,
        m in (e or {}).get("maps_to", {}).items() if m.get("linguistic_set") and m.get("calibrated_membership") is not None
    ]
    return spark.createDataFrame(rows, "item string, severity string, code string")


def overall(findings: DataFrame) -> DataFrame:
    """``findings`` and, as one more, what they allow."""
    r = readiness(findings)
    level = F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("info")
    return findings.union(r.select(F.lit("overall"), level, F.col("overall")))


def gold_findings(evaluation: DataFrame) -> DataFrame:
    return finding(evaluation.where("status = 'needs_gold_standard'"), F.coalesce("metric", F.lit("unknown_metric")), "warning", "missing_gold_standard")


def readiness(findings: DataFrame) -> DataFrame:
    """Counts by severity and what they allow."""
    n = findings.agg(*[F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s + "s") for s in ("error", "warning")])
    return n.select(F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings")).withColumn(
        "overall", F.when(F.col("errors") > 0, "not_ready").when(F.col("warnings") > 0, "exploratory_ready").otherwise("formal_ready")
    )
