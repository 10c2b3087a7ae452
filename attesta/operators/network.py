"""The relation network as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def nodes(parts: list[DataFrame]) -> DataFrame:
    """Nodes (node_id, node_type, label); of one id the first part's stays."""
    tagged = [p.select(F.lit(i).alias("at"), "node_id", "node_type", "label") for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.union(t)
    return both.groupBy("node_id").agg(F.min(F.struct("at", "node_type", "label")).alias("f")).select("node_id", "f.node_type", "f.label")


def relation_network(observations: DataFrame, memberships: DataFrame, rules: DataFrame, results: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a build, each id with its kind before it. Nodes:
    sources, observations, fuzzy variables, rules (with their name),
    conclusions and global conclusions; edges carry evidence, threshold or
    review status where they have one."""
    fired = results.where("status = 'fired'")
    of = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    label = F.coalesce(F.nullif("standard_observation", F.lit("")), "feature_value")
    a = rules.select("rule_id", F.explode("antecedents").alias("a")).select(
        "rule_id", F.concat_ws(".", "a.variable", "a.fuzzy_set").alias("key"), "a.weight", "a.threshold"
    )

    def node(d: DataFrame, kind: str, c: str, node_type=None, name=None) -> DataFrame:
        return d.select(
            of(kind, F.col(c)).alias("node_id"), (F.lit(kind) if node_type is None else node_type).alias("node_type"),
            (F.col(c) if name is None else name).cast("string").alias("label")
        ).distinct()

    found = nodes([
        node(observations, "source", "source_id"), node(
            observations, "observation", "standard_observation", name=label
        ), node(memberships, "fuzzy_variable", "variable_key"), node(memberships, "observation", "standard_observation"),
        node(rules, "rule", "rule_id"), node(
            rules, "conclusion", "consequent_entity", F.col("consequent_type")
        ), node(a, "fuzzy_variable", "key"), node(whole, "global", "consequent_entity", F.lit("global_conclusion")),
    ])
    names = rules.groupBy(of("rule", F.col("rule_id")).alias("node_id")).agg(F.first("rule_name").alias("rule_name"))
    found = found.join(names, "node_id", "left")

    def edge(d: DataFrame, source, target, kind: str, weight: str, **more) -> DataFrame:
        cols = {"evidence": "string", "threshold": "double", "review_status": "string"}
        return d.select(
            source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), F.col(weight).cast("double").alias("weight"),
            *[more.get(n, F.lit(None)).cast(t).alias(n) for n, t in cols.items()]
        )

    s, o = of("source", F.col("source_id")), of("observation", F.col("standard_observation"))
    parts = [
        edge(observations, s, o, "contains_observation", "extraction_confidence", evidence=F.col("evidence_text")), edge(
            memberships, o, of("fuzzy_variable", F.col("variable_key")), "maps_to_membership", "membership", evidence=F.col("membership_id")
        ),
        edge(a, of("fuzzy_variable", F.col("key")), of("rule", F.col("rule_id")), "antecedent_of", "weight", threshold=F.col("threshold")), edge(
            rules, of("rule", F.col("rule_id")), of("conclusion", F.col("consequent_entity")), "infers", "rule_weight",
            review_status=F.col("review_status")
        ),
        edge(fired, s, of("rule", F.col("rule_id")), "activates_rule", "activation", evidence=F.array_join("supporting_variables", ";")), edge(
            whole, of("conclusion", F.col("consequent_entity")), of("global", F.col("consequent_entity")), "aggregates_to_global",
            "membership", evidence=F.col("evidence_count").cast("string")
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return found, out
