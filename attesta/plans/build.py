"""The assembled build: a chapter table and a configuration to all tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import aggregate, assess, calibrate, evaluate, extract, infer, membership, network, patterns, report, rules, validate
from ..sources.shared import written

SCALARS, TAGS = ["topic_hint", "tradition_id", "text_family", "citation_family", "text_type"], ["school_tag", "region_tag"]
ENTITY = [
    "entity_id", "entity_name", "entity_type", "normalized_name", "synonyms", "ancient_terms", "modern_mapping", "parent_category",
    "definition", "review_status"
]


def observed(sources: DataFrame, found: list | None = None) -> DataFrame:
    """Observations of sources by patterns (the built-in ones by default)."""
    texts = sources.select("source_id", "source_seq", extract.chosen_text().alias("text"))
    return extract.extract_by_patterns(texts, extract.PATTERNS if found is None else found, keep=("source_id", "source_seq"))


def lexicon_rows(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Entities, mappings and linguistic values as one table; columns that a
    kind lacks are null."""
    e = entities(spark, config).withColumn("lexicon_section", F.lit("entity"))
    m = spark.createDataFrame(
        [("observation_mapping", str(k), str(v), "pending") for k, v in config.get("observation_mapping", {}).items()],
        "lexicon_section string, raw_term string, standard_observation string, review_status string"
    )
    v = calibrate.scoring_tasks(spark, config).select(
        F.lit("linguistic_value").alias("lexicon_section"), F.col("term").alias("raw_term"), "feature", "variable", "fuzzy_set",
        "prior_membership", F.col("current_status").alias("status"), "review_status"
    )
    return e.unionByName(m, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)


def entities(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    rows = [tuple(None if e.get(c) is None else str(e[c]) for c in ENTITY) for e in config.get("entities", [])]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ENTITY))


def summary(t: dict[str, DataFrame]) -> DataFrame:
    """One row of counts."""
    names = {
        "source_count": "source_units", "observation_count": "observations", "membership_count": "memberships",
        "candidate_pattern_count": "candidate_patterns", "rule_count": "rules", "inference_result_count": "inference_results",
        "mamdani_result_count": "mamdani_results", "evaluation_metric_count": "evaluation_results"
    }
    parts = [t[v].agg(F.count("*").alias(k)) for k, v in names.items()]
    parts.append(membership.coverage(t["observations"], t["memberships"]).select("coverage"))
    return reduce(DataFrame.crossJoin, parts)  # one row each


def build(
    sources: DataFrame, config: dict[str, Any], observations: DataFrame | None = None, reviewed: DataFrame | None = None,
    gold: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """All tables of a build, by name.

    ``sources``: as from ``tables.chapters``. ``observations``: rows of an
    extraction made elsewhere (source_id, source_seq, pattern_idx, feature,
    feature_value, evidence_text, extraction_confidence), else the built-in
    patterns are used. ``reviewed``: rows of an expert's rule review.
    Sources, observations, memberships and inferences are tables in the shared
    folder, as much depends on them; the rest is computed when asked for.
    """
    spark = sources.sparkSession
    sources = written(sources, "sources")
    raw = observed(sources) if observations is None else observations
    o = extract.standardize(raw, config.get("observation_mapping", {}))
    o = extract.number(o, ["source_seq", "pattern_idx"], "observation_seq")
    o = written(
        o.select(
            F.format_string("OBS_%06d", "observation_seq").alias("observation_id"), "*", F.lit("pending").alias("review_status"),
            S.observation_key(F.col("standard_observation"), F.col("feature"), F.col("feature_value")).alias("observation_key")
        ),
        "observations"
    )
    m = membership.memberships(o, membership.lexicon(spark, config))
    m = m.select(
        "observation_id", "observation_seq", "source_id", "standard_observation", "variable", "fuzzy_set",
        S.variable_key(F.col("variable"), F.col("fuzzy_set")).alias("variable_key"), "membership", "calculation_mode", "status", "icc",
        "p5", "p95", "uncertainty_width", "maps_idx"
    )
    m = extract.number(m, ["observation_seq", "maps_idx"], "seq")
    m = written(m.select(F.format_string("MEM_%06d", "seq").alias("membership_id"), "*"), "memberships")
    found = written(patterns.mine_patterns(o.withColumn("seq", F.col("observation_seq")), sources, config.get("candidate_pattern_filter", {})), "candidates")
    r = written(rules.load_rules(spark, config, reviewed), "rules")
    results = written(infer.larsen(infer.best_memberships(m), r), "inferences")
    fired = results.where("status = 'fired'")
    spec = config.get("mamdani_sensitivity", {})
    shapes = {k: (v["points"] if isinstance(v, dict) else v) for k, v in config.get("consequent_fuzzy_sets", {}).items()}
    centroids = infer.mamdani(fired if spec.get("enabled", True) else fired.limit(0), infer.shapes_of(r, shapes), int(spec.get("points", 200)))
    spec = config.get("aggregation", {})
    meta = infer.last_of(
        sources.select("source_id", "tradition_id", "book_name", F.round("quality", 6).alias("quality_weight"), "source_seq"),
        ["source_id"], "source_seq"
    ).drop("source_seq")
    by_source = aggregate.by_source(fired, r, meta, float(spec.get("source_rule_discount_gamma", 0.5)))
    by_tradition = aggregate.by_tradition(by_source)
    deltas = spark.createDataFrame([(k, float(v)) for k, v in spec.get("tradition_independence_weights", {}).items()], "tradition_id string, delta double")
    whole = aggregate.noisy_or(by_tradition, deltas, float(spec.get("default_tradition_delta", 1.0)))
    levels = written(aggregate.all_levels(by_source, by_tradition, whole), "levels")
    nodes, edges = network.relation_network(o, m, r, results, levels.where("level = 'global'"))
    named = entities(spark, config)
    metrics = written(evaluate.evaluation(m, results, named, gold or {}), "metrics")
    t = {
        "source_units": sources, "source_metadata": sources.select(
            "source_id", "school_tag", "region_tag", "tradition_id", "text_family", "citation_family", "source_authority", "text_integrity",
            "semantic_clarity"
        ), "observations": o, "memberships": m,
        "observation_itemsets": patterns.items_of(o).groupBy("source_id").agg(
            F.sort_array(F.collect_set("item")).alias("observations")
        ), "candidate_patterns": found, "cooccurrence_stats": found, "rules": r, "inference_results": results, "mamdani_results": centroids, "aggregation_results": levels,
        "unmapped_observations": extract.unmapped_log(
            o, float(config.get("mapping_policy", {}).get("trigger_review_if_confidence_above", 0.85))
        ), "expert_rule_review": rules.review_template(found), "entities": named,
        "observation_mapping": spark.createDataFrame(
            [(str(k), str(v)) for k, v in config.get("observation_mapping", {}).items()], "raw string, standard_observation string"
        ), "fuzzy_sets": spark.createDataFrame(membership.fuzzy_sets(config), "variable string, fuzzy_set string, points array<double>"),
        "relation_nodes": nodes, "relation_edges": edges, "evaluation_results": metrics, "evaluation_gold_templates": evaluate.gold_templates(spark), "ontology_lexicon": lexicon_rows(
            spark, config
        ),
        "expert_calibration_template": calibrate.calibration_template(m, o, ["seq"]), "source_stratification": aggregate.stratify(
            sources, SCALARS, TAGS
        ), "rule_lifecycle": rules.lifecycle(found, r),
    }
    t["summary"] = written(summary(t), "summary")
    uncertain = validate.uncertain_metadata(sources, "source_id", validate.METADATA)
    findings = validate.union(
        validate.config_findings(spark, config), validate.ignored_priors(spark, config), validate.source_findings(
            sources, "source_id", ["text_original", "text_punctuated", "text_modern"], uncertain
        ), validate.coverage_findings(o, m, ["observation_seq"]),
        validate.sample_findings(sources), validate.rule_errors(r), validate.inactive_rules(r), validate.gold_findings(metrics),
    )
    if reviewed is not None:
        findings = validate.union(findings, rules.unread_antecedents(reviewed))
    t["validation_report"] = written(validate.overall(findings), "findings")
    t["implementation_audit"] = written(assess.capabilities(t), "audit")
    t["methodology_compliance"] = assess.methods(t["implementation_audit"])
    t["completion_assessment"] = assess.assessment(t["validation_report"], t["implementation_audit"], metrics)
    t["wiki_pages"] = report.all_pages(t, int(config.get("wiki_output", {}).get("max_candidate_pattern_pages", 1000)))
    return t
