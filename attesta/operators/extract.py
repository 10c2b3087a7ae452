"""Observations from texts and their standard names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import clamp01, recover_payload_udf
from ..sources.shared import written

#: Features that model answers may name; all others become ``other`` (fixed values).
FEATURES = [
    "symptom", "sign", "tongue", "pulse", "body_part", "pathogen", "trigger", "relieving_factor", "aggravating_factor", "duration",
    "severity", "pain_location", "pain_quality", "disease_course", "formula", "herb", "acupoint", "method", "mechanism", "other"
]
#: Needle, feature, value, evidence and confidence of the built-in extraction (fixed values).
PATTERNS = [
    ("腰", "pain_location", "腰部", "腰", 0.94),
    ("腰痛", "pain_location", "腰部", "腰痛", 0.94),
    ("冷痛", "pain_quality", "冷痛", "冷痛", 0.93),
    ("痛而冷", "pain_quality", "冷痛", "痛而冷", 0.93),
    ("腰痛而冷", "pain_quality", "冷痛", "腰痛而冷", 0.93),
    ("得温则缓", "relieving_factor", "得温则缓", "得温则缓", 0.91),
    ("温之稍安", "relieving_factor", "得温则缓", "温之稍安", 0.90),
    ("遇寒", "aggravating_factor", "遇寒加重", "遇寒", 0.89),
    ("久病", "disease_course", "久病", "久病", 0.88),
    ("不愈", "disease_course", "久病", "不愈", 0.82),
    ("刺痛", "pain_quality", "刺痛不移", "刺痛", 0.90),
    ("不移", "pain_quality", "刺痛不移", "不移", 0.86),
    ("夜间加重", "aggravating_factor", "夜间加重", "夜间加重", 0.88),
    ("苔黄腻", "tongue", "苔黄腻", "苔黄腻", 0.92),
    ("脉弦", "pulse", "脉弦", "脉弦", 0.90),
    ("腰膝酸软", "symptom", "腰膝酸软", "腰膝酸软", 0.93),
]
Patterns = list[tuple[str, str, str, str, float]]


def number(df: DataFrame, order: list, name: str, prefix: str | None = None) -> DataFrame:
    """``df`` with a number from 1 in the given order, of any types, without
    one task that sees all rows: rows are dealt into ranges by sampled
    quantiles, sorted there and written; then each range's number of rows
    gives the next its first number."""
    out = _numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    return out.withColumn(name, F.format_string(prefix + "_%06d", name)) if prefix else out


def number_as_read(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number from 1 in the order in which it comes: of a file,
    its lines; files and their splits in the order in which Spark reads them."""
    return _numbered(df, name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    at = written(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    first = sizes.select(
        "__part",
        F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first")
    )
    return at.join(F.broadcast(first), part == F.col("__part")).withColumn(name, (F.col("__first") + place + 1).cast("long")).drop("__at", "__part", "__first")


def chosen_text(*names: str) -> Column:
    """The first of the texts that isn't empty: original, punctuated, modern."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names or ("text_original", "text_punctuated", "text_modern")], F.lit(""))


def extract_by_patterns(sources: DataFrame, patterns: Patterns, text: str = "text", keep: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """One row per pattern found in a text: ``keep``, pattern_idx, feature,
    feature_value, evidence_text, extraction_confidence. Of patterns with one
    feature and value the first wins. The patterns are a literal array, so
    this is a filter and an explode: no shuffle."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pattern_idx"), F.lit(n).alias("needle"), F.lit(f).alias("feature"), F.lit(v).alias("feature_value"),
                F.lit(e).alias("evidence_text"), F.lit(float(c)).alias("extraction_confidence")
            ) for i,
            (n, f, v, e, c) in enumerate(patterns)
        ]
    )
    found = F.filter(rows, lambda p: F.contains(F.col(text), p["needle"]))
    first = F.filter(
        found,
        lambda p: ~F.exists(
            found,
            lambda q: (q["pattern_idx"] < p["pattern_idx"]) & (q["feature"] == p["feature"]) & (q["feature_value"] == p["feature_value"])
        )
    )
    p = F.col("p")
    return sources.select(*keep, F.explode(first).alias("p")).select(
        *keep, *[p[c].alias(c) for c in ("pattern_idx", "feature", "feature_value", "evidence_text", "extraction_confidence")]
    )


def standardize(observations: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Adds standard_observation and mapping_status: the mapping's entry of the
    value, else of the evidence, else of ``feature:value``."""
    own = F.concat_ws(":", "feature", "feature_value")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.lit(None).cast("map<string,string>")
    hit = F.coalesce(*[F.nullif(table[k], F.lit("")) for k in (F.col("feature_value"), F.col("evidence_text"), own)])
    return observations.withColumns({"standard_observation": F.coalesce(hit, own), "mapping_status": F.when(hit.isNotNull(), "mapped").otherwise("unmapped")})


def unmapped_log(observations: DataFrame, review_from: float = 0.85) -> DataFrame:
    """Observations without a standard name; those of a confidence of
    ``review_from`` or more need review."""
    label = F.when(F.col("extraction_confidence") >= review_from, "needs_review").otherwise("low_confidence")
    return observations.where("mapping_status <> 'mapped' OR coalesce(standard_observation, '') = ''").withColumn("review", label)


def answers_to_rows(answers: DataFrame, features: list[str], text: str = "answer", most: int = 0) -> DataFrame:
    """Observation rows of model answers. An answer that is one JSON object
    with a list of observations is read by the engine; only the others, with
    fences, thoughts, other names or broken JSON, go through Python to be
    recovered. Unknown features become ``other``, blank values go, ``most``
    rows per answer stay (0: all)."""
    row = "struct<feature:string,feature_value:string,evidence_text:string,extraction_confidence:string>"
    body, own = F.trim(F.col(f"`{text}`")), [F.col(f"`{c}`") for c in answers.columns if c != text]
    found = F.from_json(body, f"observations array<{row}>")["observations"]
    plain = body.startswith("{") & body.endswith("}") & ~F.contains(F.lower(body), F.lit("<think")) & ~F.contains(body, F.lit("```")) & found.isNotNull()
    first = answers.where(plain).select(*own, found.alias("__rows"))
    rest = answers.where(~F.coalesce(plain, F.lit(False))).select(*own, F.from_json(recover_payload_udf(F.col(f"`{text}`")), f"array<{row}>").alias("__rows"))
    good = F.filter("__rows", lambda r: F.coalesce(F.trim(r["feature_value"]), F.lit("")) != "")
    good = F.slice(good, 1, most) if most else good
    r = F.col("__r")
    feature: Column = F.coalesce(F.nullif(F.trim(r["feature"]), F.lit("")), F.lit("symptom"))
    return first.unionByName(rest).select(*own, F.posexplode(good).alias("row", "__r")).select(
        *own, "row", F.when(feature.isin(features), feature).otherwise("other").alias("feature"), F.trim(r["feature_value"]).alias("feature_value"),
        F.trim(F.coalesce(r["evidence_text"], F.lit(""))).alias("evidence_text"), clamp01(r["extraction_confidence"], 0.5).alias("extraction_confidence"),
    )
