"""Fuzzy rules from seed and reviewed rows, review templates and lifecycle."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import clamp01, safe_float
from .infer import accepted_rules

ANTECEDENT = "struct<variable:string,fuzzy_set:string,threshold:double,weight:double>"
TEXTS = (
    "rule_id", "rule_name", "rule_origin", "pattern_id", "consequent_entity", "suggested_consequent", "consequent_type", "rule_weight",
    "suggested_rule_weight", "support", "confidence", "lift", "pmi", "source_count", "book_count", "tradition_count", "source_diversity",
    "tradition_entropy", "applicable_context", "conflict_with", "expert_acceptance_rate", "expert_disagreement_note", "conflict_note",
    "review_status", "created_from", "last_updated", "expert_decision"
)


def _filled(c: Column) -> Column:
    """The value as it stands, null if blank or not a number."""
    t = c.cast("string")
    return F.when((F.trim(t) != "") & (F.lower(F.trim(t)) != "nan"), t)


def _json_antecedents(cell: Column) -> Column:
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    return F.from_json(cell, "array<struct<variable:string,fuzzy_set:string,threshold:string,weight:string>>", options)


def _loose_antecedents(cell: Column) -> Column:
    """Antecedents of lists that aren't JSON but whose items are clear: in
    braces, with plain words as values, or a dash and a line for each name."""

    def item(text: Column, stop: str) -> Column:
        def value(name: str) -> Column:
            found = F.regexp_extract(text, f"""(?:^|[{stop}])\\s*["']?{name}["']?\\s*:\\s*("[^"]*"|'[^']*'|[^{stop}]*)""", 1)
            return F.nullif(F.trim(F.regexp_replace(F.trim(found), """^["']|["']$""", "")), F.lit("")).alias(name)

        return F.struct(*[value(n) for n in ("variable", "fuzzy_set", "threshold", "weight")])

    t = F.trim(cell)
    braces = F.transform(F.regexp_extract_all(t, F.lit(r"\{([^{}]*)\}"), 1), lambda x: item(x, ",\n"))
    dashes = F.transform(F.filter(F.split(t, r"(?:^|\n)\s*-\s+"), lambda x: F.trim(x) != ""), lambda x: item(x, "\n"))
    return F.when(t.rlike(r"^[\[{]"), braces).when(t.rlike(r"^-\s"), dashes)


def parse_antecedents(cell: Column) -> Column:
    """Antecedents of a JSON list (single quotes and bare names allowed), else
    of a list written loosely, in braces or with dashes: rows without a
    variable go; fuzzy_set is ``high``, threshold 0 and weight 1 by default.
    Anything else is an empty list (``unread_antecedents`` reports it)."""
    none = F.array().cast("array<struct<variable:string,fuzzy_set:string,threshold:string,weight:string>>")
    named = lambda rows: F.filter(F.coalesce(rows, none), lambda a: F.coalesce(F.trim(a["variable"]), F.lit("")) != "")
    exact, loose = named(_json_antecedents(cell)), named(_loose_antecedents(cell))
    good = F.when(F.size(exact) > 0, exact).otherwise(loose)
    return F.transform(good, lambda a: F.struct(
        a["variable"].alias("variable"), F.coalesce(a["fuzzy_set"], F.lit("high")).alias("fuzzy_set"),
        safe_float(a["threshold"], 0.0).alias("threshold"), safe_float(a["weight"], 1.0).alias("weight")))


def antecedent_cell(rows: DataFrame) -> Column:
    """The cell of antecedents as text: ``antecedents``, even a blank one,
    hides ``antecedents_json``."""
    names = [c for c in ("antecedents", "antecedents_json") if c in rows.columns]
    if not names:
        return F.lit("[]")
    c = F.col(names[0])
    return c.cast("string") if rows.schema[names[0]].dataType.typeName() != "array" else F.to_json(c)


def unread_antecedents(rows: DataFrame, key: str = "rule_id") -> DataFrame:
    """Findings (item, severity, code) for rows whose cell of antecedents holds
    something of which no antecedent could be read, so no rule goes silently."""
    cell = F.trim(F.coalesce(antecedent_cell(rows), F.lit("")))
    held = (cell != "") & ~F.lower(cell).isin("nan", "[]", "null", "none")
    item = F.coalesce(F.col(key).cast("string"), F.lit("")) if key in rows.columns else F.substring(cell, 1, 80)
    found = rows.where(held & (F.size(parse_antecedents(cell)) == 0))
    return found.select(item.alias("item"), F.lit("error").alias("severity"), F.lit("unreadable_antecedents").alias("code"))


def _listed(c: Column) -> Column:
    """A list cell: a JSON list, else parts between semicolons."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    parts = F.filter(F.transform(F.split(t, "[;；]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(parts)


def build_rules(rows: DataFrame) -> DataFrame:
    """Rules of seed or reviewed rows, whose columns may lack or hold blanks.

    Rows that an expert refused or left pending, and rows without antecedents
    or consequent, are skipped. A column ``antecedents`` (a list of structs or
    a JSON text), even a blank one, hides ``antecedents_json``. The consequent
    is consequent_entity, else suggested_consequent, else the entity of
    ``consequent`` (a struct, JSON text, or the plain name).
    """
    has = set(rows.columns)
    d = rows.select(*rows.columns, *[F.lit(None).cast("string").alias(c) for c in TEXTS if c not in has])
    t = {c: _filled(F.col(c)) for c in TEXTS}
    antecedents = parse_antecedents(antecedent_cell(rows))
    entity, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    if "consequent" in has:
        struct = rows.schema["consequent"].dataType.typeName() == "struct"
        cell = F.to_json("consequent") if struct else F.trim(F.col("consequent").cast("string"))
        parsed = F.from_json(cell, "struct<entity:string,entity_type:string>", {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})
        entity, kind = F.when(cell.startswith("{"), _filled(parsed["entity"])).otherwise(_filled(cell)), F.when(
            cell.startswith("{"), _filled(parsed["entity_type"])
        )
    consequent = F.coalesce(t["consequent_entity"], t["suggested_consequent"], entity)
    pattern = F.coalesce(t["pattern_id"], F.lit(""))
    number = lambda c: safe_float(F.col(c), 0.0).alias(c)
    count = lambda c: safe_float(F.col(c), 0.0).cast("long").alias(c)
    text = lambda c, *others: F.coalesce(t[c], *others, F.lit("")).alias(c)
    listed = lambda c: (
        F.col(c).cast(
            "array<string>"
        ) if c in has and rows.schema[c].dataType.typeName() == "array" else _listed(F.col(c)) if c in has else F.array().cast("array<string>")
    ).alias(c)
    return accepted_rules(d).select(
        F.coalesce(
            t["rule_id"], F.when(pattern != "", F.concat(F.lit("RULE_FROM_"), pattern)), F.lit("RULE_UNSPECIFIED")
        ).alias("rule_id"), F.coalesce(t["rule_name"], t["pattern_id"], consequent).alias("rule_name"), F.coalesce(t["rule_origin"], F.lit("cooccurrence_induced")).alias("rule_origin"), pattern.alias("pattern_id"),
        antecedents.alias("antecedents"), consequent.alias("consequent_entity"), F.coalesce(t["consequent_type"], kind, F.lit("syndrome")).alias("consequent_type"), clamp01(
            F.coalesce(t["rule_weight"], t["suggested_rule_weight"], F.lit("1")), 1.0
        ).alias("rule_weight"),
        number("support"), number("confidence"), number("lift"), number("pmi"), count("source_count"), listed("source_ids"), count("book_count"), count("tradition_count"), listed("tradition_ids"), number("source_diversity"), number(
            "tradition_entropy"
        ),
        text("applicable_context"), text("conflict_with"), number("expert_acceptance_rate"), text(
            "expert_disagreement_note", t["conflict_note"]
        ), F.coalesce(t["review_status"], F.lit("active_rule")).alias("review_status"), text("created_from", t["pattern_id"]), text("last_updated"),
    ).where((F.size("antecedents") > 0) & (F.coalesce("consequent_entity", F.lit("")) != ""))


def seed_rows(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """The seed rules of a configuration as rows for ``build_rules``."""
    import json

    names = [*TEXTS, "source_ids", "tradition_ids"]
    cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    rows = [(*(cell(r.get(n)) for n in names), cell(r.get("antecedents", r.get("antecedents_json", []))), cell(r.get("consequent"))) for r in config.get("seed_rules", [])]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in [*names, "antecedents", "consequent"]))


def load_rules(spark: SparkSession, config: dict[str, Any], reviewed: DataFrame | None = None) -> DataFrame:
    """Seed rules, then the rules of a reviewed table."""
    seed = build_rules(seed_rows(spark, config))
    return seed if reviewed is None else seed.unionByName(build_rules(reviewed))


def review_template(patterns: DataFrame) -> DataFrame:
    """Patterns as rows for an expert to decide on."""
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    return patterns.select(
        "pattern_id", F.col("items").alias(
            "observations"
        ), F.col("items").alias("itemset"), "size", "support", "confidence", "lift", "pmi", "fisher_p", "jaccard", "source_count", "book_count", "tradition_count", "source_diversity", "tradition_entropy", "possible_interpretation", "source_ids", "source_count_summary", "mapping_status_summary", "book_names", "tradition_ids", "representative_evidence",
        F.lit("pending").alias("expert_decision"), F.lit("[]").alias("antecedents_json"), *blank(
            "suggested_consequent", "suggested_rule_weight", "applicable_context", "conflict_note"
        ), "review_status",
    )


def lifecycle(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Where each pattern and rule stands and what is expected next."""
    p = patterns.select(
        F.col("pattern_id").alias("artifact_id"), F.lit("candidate_pattern").alias("artifact_type"),
        F.col("review_status").alias("lifecycle_state"), F.lit("observation_itemset").alias("created_from"),
        F.lit("expert_reviewed_pattern").alias("next_expected_state"), F.col("source_count").cast("long").alias("source_count"), "support"
    )
    verified = F.col("review_status").isin("expert_verified", "expert_verified_rule")
    r = rules.select(
        F.col("rule_id").alias("artifact_id"), F.lit("rule").alias("artifact_type"), F.col("review_status").alias("lifecycle_state"),
        F.coalesce(_filled(F.col("created_from")), _filled(F.col("pattern_id")), F.col("rule_origin")).alias("created_from"),
        F.when(verified, "active_rule").otherwise("expert_review_or_monitoring").alias("next_expected_state"),
        F.col("source_count").cast("long").alias("source_count"), "support"
    )
    return p.unionByName(r)
