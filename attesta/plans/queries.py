"""The engine's operators over the driver's tables, each with the SQL that
checks it. Documents are sources, orders are baskets, events are observations,
conversations are the chunk log."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S, table_functions
from ..operators import aggregate, assess, calibrate, chunks, evaluate, extract, infer, membership, mining, network, patterns, report, rules as rule_rows, validate
from ..sources import tables
from ..sources.shared import beside, new_path, parts_for, written
from ..streaming import chunk_log as logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: needle, feature, value, evidence, confidence
PATTERNS = [
    ("the ", "lang_mark", "english", "the", 0.94), ("and", "lang_mark", "english", "and", 0.90),
    (" der ", "lang_mark", "german", "der", 0.93), ("que", "ending", "que", "que", 0.80), ("tion", "ending", "tion", "tion", 0.86),
    (" de ", "article", "de", "de", 0.70), ("License", "legal", "license", "License", 0.95)
]
MAPPING = {"english": "lang:en", "der": "lang:de", "legal:license": "legal:line"}
TERMS = [
    ("click", "interest", "high", 0.62, 0.55, 0.70), ("purchase", "interest", "high", 0.9, None, None),
    ("purchase", "value", "high", 0.8, None, None), ("kind:view", "interest", "low", 0.3, 0.2, 0.41)
]
RULES = [
    ("R1", "bulk", "deal", 0.84, 0.80, "active_rule", None, [("N", "O", 0.5, 0.6), ("A", "F", 0.2, 0.4)]),
    ("R2", "returned", "risk", 0.82, None, "active_rule", "accept", [("R", "F", 0.4, 1.0)]),
    ("R3", "bulk", "deal", 0.05, 0.02, "expert_verified", "pending", [("N", "O", 0.0, 0.3), ("N", "F", 0.0, 0.1)]),
    ("R4", "none", "risk", 0.9, 0.9, "draft", "reject", [("A", "F", 0.0, 1.0)]),
]
SHAPES = [("R1", 0.45, 0.70, 1.0, 1.0), ("R2", 0.2, 0.4, 0.6, 0.8), ("R3", 0.0, 0.3, 0.5, 0.9)]
PAIRS = [
    ("warm", 0.2, 0.4, 0.8, 1.0, 0.2, 0.4, 0.8, 1.0), ("cold", 0.7, 0.86, 1.0, 1.0, 0.6, 0.78, 1.0, 1.0),
    ("apart", 0.0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.7, 0.8)
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lit(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)


def values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


# --- shared inputs ---


def observations(spark, d):
    """Events as observations."""
    e = t(spark, d, "events")
    return e.select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("source_id"), F.lit("kind").alias("feature"),
        F.col("event_type").alias("feature_value"), F.concat(F.lit("kind:"), "event_type").alias("standard_observation")
    )


OBS = "SELECT event_id AS observation_id, user_id AS source_id, event_type AS feature_value, 'kind:' || event_type AS standard_observation FROM events"


def members(spark, d):
    """Line items as memberships of the variables of their flags."""
    mu = F.round(F.least(F.lit(1.0), F.col("l_discount") * 8 + 0.2), 6)
    low = (F.col("l_linenumber") % 2) == 0
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), S.variable_key(F.col("l_returnflag"), F.col("l_linestatus")).alias("variable_key"),
        F.col("l_linenumber").alias("seq"), mu.alias("membership"), F.when(low, F.round(mu * 0.9, 6)).alias("p5"),
        F.when(low, F.round(F.least(F.lit(1.0), mu * 1.1), 6)).alias("p95")
    )


BEST = """best AS (
  SELECT source_id, variable_key, membership, p5, p95 FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, variable_key ORDER BY membership DESC, seq) AS n FROM (
      SELECT l_orderkey AS source_id, l_returnflag || '.' || l_linestatus AS variable_key, l_linenumber AS seq, mu AS membership,
        CASE WHEN l_linenumber % 2 = 0 THEN round(mu * 0.9, 6) END AS p5, CASE WHEN l_linenumber % 2 = 0 THEN round(least(1.0, mu * 1.1), 6) END AS p95
      FROM (SELECT *, round(least(1.0, l_discount * 8 + 0.2), 6) AS mu FROM lineitem))) WHERE n = 1)"""


def rules(spark):
    return spark.createDataFrame(
        [(i, e, c, w, a, s, x, [(v, f, th, wt) for v, f, th, wt in ants]) for i, e, c, w, a, s, x, ants in RULES],
        "rule_id string, consequent_entity string, consequent_type string, rule_weight double, expert_acceptance_rate double, review_status string, expert_decision string, antecedents array<struct<variable:string,fuzzy_set:string,threshold:double,weight:double>>"
    )


RULE_ROWS = values([r[:7] for r in RULES], "rule_id, consequent_entity, consequent_type, rule_weight, expert_acceptance_rate, review_status, expert_decision")
ANTE_ROWS = values([(r[0], i, f"{v}.{f}", th, w) for r in RULES for i, (v, f, th, w) in enumerate(r[7])], "rule_id, i, key, threshold, weight")
LARSEN = f"""{BEST}, rules AS (SELECT * FROM {RULE_ROWS}), ants AS (SELECT * FROM {ANTE_ROWS}), larsen AS (
  SELECT source_id, rule_id, any_value(consequent_entity) AS consequent_entity,
    round(greatest(0, least(1, any_value(rule_weight) * product(pow(greatest(coalesce(membership, 0), 1e-12), weight)))), 6) AS activation,
    CASE WHEN count(*) FILTER (WHERE coalesce(membership, 0) < threshold) = 0 THEN 'fired' ELSE 'below_threshold' END AS status,
    coalesce(string_agg(key, ',' ORDER BY i) FILTER (WHERE coalesce(membership, 0) < threshold), '') AS missing,
    CASE WHEN count(p5) > 0 THEN round(greatest(0, least(1, any_value(rule_weight) * product(pow(greatest(coalesce(p5, membership, 0), 1e-12), weight)))), 6) END AS p5,
    CASE WHEN count(p5) > 0 THEN round(greatest(0, least(1, any_value(rule_weight) * product(pow(greatest(coalesce(p95, membership, 0), 1e-12), weight)))), 6) END AS p95
  FROM (SELECT DISTINCT source_id FROM best) CROSS JOIN rules JOIN ants USING (rule_id) LEFT JOIN (SELECT source_id AS s, variable_key AS key, membership, p5, p95 FROM best) b ON b.s = source_id AND b.key = ants.key
  WHERE review_status IN ('active_rule', 'expert_verified', 'expert_verified_rule') GROUP BY source_id, rule_id)""".replace("string_agg(key", "string_agg(ants.key")


def inferred(spark, d):
    return infer.larsen(infer.best_memberships(members(spark, d)), rules(spark))


def fired_rows(spark, d):
    return infer.fired(infer.best_memberships(members(spark, d)), rules(spark))


def sources_meta(spark, d):
    """Orders with market segment as book and region as tradition."""
    geo = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = t(spark, d, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    return t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("source_id"), F.col("r_name").alias("tradition_id"), F.col("c_mktsegment").alias("book_name"),
        F.lit(0.8).alias("quality_weight")
    )


META = "meta AS (SELECT o_orderkey AS source_id, r_name AS tradition_id, c_mktsegment AS book_name, 0.8::DOUBLE AS quality_weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SOURCE_LEVEL = f"""{LARSEN}, {META}, src AS (
  SELECT source_id, consequent_entity, count(*) AS n_rules, pow(count(*), -0.5) AS discount, sum(q) * pow(count(*), -0.5) AS total_weight, round(sum(q * activation) / sum(q), 6) AS membership
  FROM larsen JOIN (SELECT rule_id, greatest(rule_weight, coalesce(expert_acceptance_rate, 0), 0.1) AS q FROM rules) USING (rule_id) WHERE status = 'fired' GROUP BY ALL
), source_level AS (SELECT * FROM src JOIN meta USING (source_id)), tradition_level AS (
  SELECT tradition_id, consequent_entity, round(sum(quality_weight * membership) / sum(quality_weight), 6) AS membership, sum(n_rules)::BIGINT AS evidence_count, count(*) AS source_count FROM source_level GROUP BY ALL
), global_level AS (
  SELECT consequent_entity, round(greatest(0, least(1, 1 - product(1 - coalesce(delta, 1.0) * membership))), 6) AS membership, sum(evidence_count)::BIGINT AS evidence_count, count(*) AS tradition_count
  FROM tradition_level LEFT JOIN {values([("ASIA", 0.5), ("EUROPE", 0.85)], "tradition_id, delta")} USING (tradition_id) GROUP BY ALL)"""


def source_level(spark, d, fired=None):
    return aggregate.by_source(fired_rows(spark, d) if fired is None else fired, rules(spark), sources_meta(spark, d))


def global_level(spark, d, fired=None):
    return aggregate.noisy_or(
        aggregate.by_tradition(source_level(spark, d, fired)),
        spark.createDataFrame([("ASIA", 0.5), ("EUROPE", 0.85)], "tradition_id string, delta double")
    )


def baskets(spark, d):
    """Kinds of parts in each order."""
    p = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("item"))
    return t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("source_id"), "item").distinct()


BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS source_id, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), singles AS (SELECT item, count(*) AS n FROM baskets GROUP BY 1), total AS (SELECT count(*)::DOUBLE AS total FROM orders)"


# --- memberships ---


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0.1 OR x > 0.9 THEN 0 WHEN x >= 0.3 AND x <= 0.5 THEN 1 WHEN x < 0.3 THEN (x - 0.1) / (0.3 - 0.1) ELSE (0.9 - x) / (0.9 - 0.5) END, 6) AS membership FROM (SELECT *, l_discount * 10 AS x FROM lineitem)")
def trapezoid_membership(spark, d):
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(S.trapezoid(F.col("l_discount") * 10, *[F.lit(p) for p in (0.1, 0.3, 0.5, 0.9)]), 6).alias("membership")
    )


SHAPED = "SELECT p_partkey AS key, p_size / 100.0::DOUBLE AS l0, p_size / 100.0::DOUBLE + 0.1::DOUBLE AS l1, p_size / 100.0::DOUBLE + 0.2::DOUBLE AS l2, p_size / 100.0::DOUBLE + 0.3::DOUBLE AS l3, 0.2::DOUBLE AS r0, 0.4::DOUBLE AS r1, 0.5::DOUBLE AS r2, 0.9::DOUBLE AS r3 FROM part"


@query(f"""WITH grid AS (SELECT *, least(l0, r0) + (greatest(l3, r3) - least(l0, r0)) * i / 199 AS x FROM ({SHAPED}), range(200) AS g(i)),
y AS (SELECT *, CASE WHEN x < l0 OR x > l3 THEN 0 WHEN x >= l1 AND x <= l2 THEN 1 WHEN x < l1 THEN (x - l0) / (l1 - l0) ELSE (l3 - x) / (l3 - l2) END AS y, CASE WHEN x < r0 OR x > r3 THEN 0 WHEN x >= r1 AND x <= r2 THEN 1 WHEN x < r1 THEN (x - r0) / (r1 - r0) ELSE (r3 - x) / (r3 - r2) END AS r FROM grid),
a AS (SELECT key, (y + lead(y) OVER w) * (lead(x) OVER w - x) / 2 AS ay, (y * r + lead(y * r) OVER w) * (lead(x) OVER w - x) / 2 AS az FROM y WINDOW w AS (PARTITION BY key ORDER BY i))
SELECT key, round(coalesce(sum(az) / nullif(sum(ay), 0), 0), 6) AS overlap FROM a GROUP BY key""")
def overlap_lexicon(spark, d):
    low = F.col("p_size") / F.lit(100.0)
    shape = {"l0": low, "l1": low + 0.1, "l2": low + 0.2, "l3": low + 0.3, "r0": F.lit(0.2), "r1": F.lit(0.4), "r2": F.lit(0.5), "r3": F.lit(0.9)}
    return membership.overlap_table(t(spark, d, "part").select(F.col("p_partkey").alias("key"), *[c.alias(n) for n, c in shape.items()]))


LEX = values([(*r, i) for i, r in enumerate(TERMS)], "term, variable, fuzzy_set, membership, p5, p95, i")


def lexicon(spark):
    return spark.createDataFrame(TERMS, "term string, variable string, fuzzy_set string, membership double, p5 double, p95 double")


@query(f"WITH o AS ({OBS}), lex AS (SELECT * FROM {LEX}), k AS (SELECT *, CASE WHEN feature_value IN (SELECT term FROM lex) THEN feature_value ELSE standard_observation END AS key FROM o) SELECT observation_id, source_id, variable, fuzzy_set, membership, p5, p95 FROM k JOIN lex ON key = term")
def prior_lookup_fallback(spark, d):
    return membership.memberships(observations(spark, d), lexicon(spark)).select(
        "observation_id", "source_id", "variable", "fuzzy_set", "membership", "p5", "p95"
    )


@query(f"SELECT count(*) FILTER (WHERE feature_value IN ('click', 'purchase', 'view')) AS mapped, count(*) AS observations, round(count(*) FILTER (WHERE feature_value IN ('click', 'purchase', 'view')) / count(*), 6) AS coverage FROM ({OBS})")
def coverage(spark, d):
    o = observations(spark, d)
    return membership.coverage(o, membership.memberships(o, lexicon(spark)))


# --- extraction ---

EXTRACT = f"""found AS (SELECT doc_id, i AS pattern_idx, feature, feature_value, evidence_text, extraction_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, feature, feature_value ORDER BY i) AS n FROM documents JOIN {values([(i, *p) for i, p in enumerate(PATTERNS)], "i, needle, feature, feature_value, evidence_text, extraction_confidence")} ON contains(text, needle)) WHERE n = 1)"""
STANDARD = f"""{EXTRACT}, std AS (SELECT found.*, coalesce(a.s, b.s, c.s, feature || ':' || feature_value) AS standard_observation, CASE WHEN coalesce(a.s, b.s, c.s) IS NULL THEN 'unmapped' ELSE 'mapped' END AS mapping_status
  FROM found LEFT JOIN {values(MAPPING.items(), "k, s").replace("AS v", "AS a")} ON a.k = feature_value LEFT JOIN {values(MAPPING.items(), "k, s").replace("AS v", "AS b")} ON b.k = evidence_text LEFT JOIN {values(MAPPING.items(), "k, s").replace("AS v", "AS c")} ON c.k = feature || ':' || feature_value)"""


def extracted(spark, d):
    return extract.extract_by_patterns(t(spark, d, "documents").select("doc_id", "text"), PATTERNS, keep=("doc_id",))


@query(f"WITH {EXTRACT} SELECT * FROM found")
def rule_extract_first_wins(spark, d):
    return extracted(spark, d)


@query(f"WITH {STANDARD} SELECT * FROM std")
def standardized_observations(spark, d):
    return extract.standardize(extracted(spark, d), MAPPING)


@query(f"WITH {STANDARD} SELECT doc_id, feature, feature_value, CASE WHEN extraction_confidence >= 0.85 THEN 'needs_review' ELSE 'low_confidence' END AS review FROM std WHERE mapping_status <> 'mapped'")
def unmapped_log(spark, d):
    return extract.unmapped_log(extract.standardize(extracted(spark, d), MAPPING)).select("doc_id", "feature", "feature_value", "review")


@query(f"WITH {EXTRACT} SELECT 'OBS_' || lpad(row_number() OVER (ORDER BY doc_id, pattern_idx)::VARCHAR, 6, '0') AS observation_id, doc_id, pattern_idx FROM found")
def numbered_observations(spark, d):
    return extract.number(extracted(spark, d), ["doc_id", "pattern_idx"], "observation_id", "OBS").select("observation_id", "doc_id", "pattern_idx")


# --- inference ---


@query(f"WITH {BEST} SELECT * FROM best")
def best_membership(spark, d):
    return infer.best_memberships(members(spark, d))


@query(f"WITH {LARSEN} SELECT source_id, rule_id, consequent_entity, activation, status, missing, p5, p95 FROM larsen")
def larsen_inference(spark, d):
    return inferred(spark, d).select(
        "source_id", "rule_id", "consequent_entity", "activation", "status", F.array_join("missing_variables", ",").alias("missing"), "p5",
        "p95"
    )


@query(f"WITH {LARSEN} SELECT source_id, rule_id, activation FROM larsen WHERE status = 'fired'")
def fired_filter(spark, d):
    return fired_rows(spark, d).select("source_id", "rule_id", "activation")


def kind_members(spark, d):
    """Line items as memberships of their part's type and brand: many variables,
    few of them in one order."""
    part = t(spark, d, "part").select("p_partkey", F.explode(F.array("p_type", "p_brand")).alias("variable"))
    mu = F.round(F.least(F.lit(1.0), F.col("l_quantity") / 50), 6)
    line = t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = line.select("l_orderkey", "l_linenumber", "variable", mu.alias("mu"), (F.col("l_linenumber") == 1).alias("ranged"))
    cells = [F.when(F.col("ranged"), F.round(F.col("mu") * x, 6)).alias(c) for x, c in ((0.5, "p5"), (0.75, "p95"))]
    return line.select(
        F.col("l_orderkey").alias("source_id"), S.variable_key(F.col("variable"), F.lit("high")).alias("variable_key"),
        F.col("l_linenumber").alias("seq"), F.col("mu").alias("membership"), *cells
    )


def kind_rules(spark, d):
    """A rule for each pair of type and brand that parts have, up to some
    thousands; some need only one of the two, one in fifty neither."""
    kinds = t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.min("p_size").alias("size"))
    size = F.col("size")
    ant = lambda c, threshold, weight: F.struct(
        F.col(c).alias("variable"), F.lit("high").alias("fuzzy_set"), threshold.alias("threshold"), F.lit(weight).alias("weight")
    )
    a = ant("p_type", F.when(size == 50, 0.0).otherwise((size % 5) / 5.0), 1.0)
    b = ant("p_brand", F.when(size == 50, 0.0).otherwise((size % 3) / 4.0), 0.5)
    return kinds.select(
        F.concat_ws(
            "/", "p_type", "p_brand"
        ).alias("rule_id"), F.col("p_brand").alias("consequent_entity"), F.lit("kind").alias("consequent_type"), (0.5 + size / 200).alias("rule_weight"),
        F.when(size % 11 == 0, "draft").otherwise("active_rule").alias("review_status"), F.array(a, b).alias("antecedents"),
    )


KIND_RULES = """mem AS (
  SELECT source_id, key, membership, p5, p95 FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, key ORDER BY membership DESC, seq) AS n FROM (
      SELECT l_orderkey AS source_id, unnest([p_type || '.high', p_brand || '.high']) AS key, l_linenumber AS seq, round(least(1.0, l_quantity / 50), 6) AS membership,
        CASE WHEN l_linenumber = 1 THEN round(round(least(1.0, l_quantity / 50), 6) * 0.5, 6) END AS p5, CASE WHEN l_linenumber = 1 THEN round(round(least(1.0, l_quantity / 50), 6) * 0.75, 6) END AS p95
      FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE n = 1
), kinds AS (
  SELECT p_type || '/' || p_brand AS rule_id, p_brand AS consequent_entity, p_type || '.high' AS k1, p_brand || '.high' AS k2, 0.5::DOUBLE + min(p_size) / 200::DOUBLE AS w,
    CASE WHEN min(p_size) = 50 THEN 0 ELSE min(p_size) % 5 / 5.0::DOUBLE END AS t1, CASE WHEN min(p_size) = 50 THEN 0 ELSE min(p_size) % 3 / 4.0::DOUBLE END AS t2
  FROM part GROUP BY p_type, p_brand HAVING min(p_size) % 11 <> 0
)"""


@query(f"""WITH {KIND_RULES}, hit AS (
  SELECT source_id, rule_id, w, any_value(membership) FILTER (WHERE key = k1) AS m1, any_value(membership) FILTER (WHERE key = k2) AS m2, any_value(p5) FILTER (WHERE key = k1) AS l1, any_value(p5) FILTER (WHERE key = k2) AS l2, any_value(p95) FILTER (WHERE key = k1) AS h1, any_value(p95) FILTER (WHERE key = k2) AS h2, t1, t2
  FROM mem JOIN (SELECT *, k1 AS k FROM kinds UNION ALL SELECT *, k2 FROM kinds) ON key = k GROUP BY source_id, rule_id, w, t1, t2
), free AS (
  SELECT s.source_id, r.rule_id, r.w, h.m1, h.m2, h.l1, h.l2, h.h1, h.h2, r.t1, r.t2 FROM (SELECT DISTINCT source_id FROM mem) s JOIN kinds r ON r.t1 <= 0 AND r.t2 <= 0 LEFT JOIN hit h ON h.source_id = s.source_id AND h.rule_id = r.rule_id
), joined AS (SELECT * FROM free UNION ALL SELECT * FROM hit WHERE t1 > 0 OR t2 > 0)
SELECT source_id, rule_id, round(least(1, w * greatest(coalesce(m1, 0), 1e-12) * pow(greatest(coalesce(m2, 0), 1e-12), 0.5)), 6) AS activation,
  CASE WHEN coalesce(l1, l2) IS NOT NULL THEN round(least(1, w * greatest(coalesce(l1, m1, 0), 1e-12) * pow(greatest(coalesce(l2, m2, 0), 1e-12), 0.5)), 6) END AS p5,
  CASE WHEN coalesce(h1, h2) IS NOT NULL THEN round(least(1, w * greatest(coalesce(h1, m1, 0), 1e-12) * pow(greatest(coalesce(h2, m2, 0), 1e-12), 0.5)), 6) END AS p95
FROM joined WHERE coalesce(m1, 0) >= t1 AND coalesce(m2, 0) >= t2""")
def rule_table_fired(spark, d):
    """Thousands of rules, looked up by the variables they need."""
    best = infer.best_memberships(kind_members(spark, d))
    return infer.fired(best, kind_rules(spark, d)).select("source_id", "rule_id", "activation", "p5", "p95")


def reviewed_rows(spark, d):
    """Suppliers as rows of an expert's rule review."""
    pick = lambda n, *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") % n + 1).cast("int"))
    ant = F.format_string("{'variable': 'v%d', 'fuzzy_set': 'high', 'threshold': 0.5}, {'variable': ' '}, {variable: 'w', weight: '2'}", "s_nationkey")
    return t(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("rule_id"), F.format_string("P%d", "s_suppkey").alias("pattern_id"), pick(
            6, " Pending", "yes", None, "REJECT", "否", "accepted"
        ).alias("expert_decision"), pick(4, "active_rule", "draft", " ", "expert_verified").alias("review_status"),
        F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("["), ant, F.lit("]"))).alias("antecedents_json"), F.when(
            F.col("s_suppkey") % 11 > 0, F.format_string("c%d", "s_nationkey")
        ).alias("suggested_consequent"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal").cast("string")).alias("suggested_rule_weight"), pick(2, "a; b；", '["c"]').alias("source_ids"),
    )


REVIEWED = """reviewed AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'RULE_FROM_P' || s_suppkey END AS rule_id, [' Pending', 'yes', NULL, 'REJECT', '否', 'accepted'][s_suppkey % 6 + 1] AS expert_decision, ['active_rule', 'draft', 'active_rule', 'expert_verified'][s_suppkey % 4 + 1] AS review_status, s_suppkey % 7 > 0 AS has_antecedents,
  CASE WHEN s_suppkey % 11 > 0 THEN 'c' || s_nationkey END AS consequent_entity, CASE WHEN s_suppkey % 2 = 0 THEN greatest(0, least(1, s_acctbal)) ELSE 1.0 END::DOUBLE AS rule_weight, ['a,b', 'c'][s_suppkey % 2 + 1] AS sources, 'v' || s_nationkey || '.high>=0.5^1.0,w.high>=0.0^2.0' AS antecedents FROM supplier)"""


@query(f"WITH {REVIEWED} SELECT rule_id, consequent_entity, round(rule_weight, 6) AS rule_weight, review_status, sources, antecedents FROM reviewed WHERE has_antecedents AND consequent_entity IS NOT NULL AND lower(trim(coalesce(expert_decision, 'accepted'))) NOT IN ('pending', 'reject', 'rejected', '否', '不通过')")
def reviewed_rules(spark, d):
    r = rule_rows.build_rules(reviewed_rows(spark, d))
    ants = F.array_join(
        F.transform(
            "antecedents",
            lambda a: F.concat(a["variable"], F.lit("."), a["fuzzy_set"], F.lit(">="), a["threshold"].cast("string"), F.lit("^"), a["weight"].cast("string"))
        ),
        ","
    )
    return r.select(
        "rule_id", "consequent_entity", F.round("rule_weight", 6).alias("rule_weight"), "review_status",
        F.array_join("source_ids", ",").alias("sources"), ants.alias("antecedents")
    )


@query(f"WITH {REVIEWED} SELECT rule_id, review_status FROM reviewed WHERE has_antecedents AND consequent_entity IS NOT NULL AND lower(trim(coalesce(expert_decision, 'accepted'))) NOT IN ('pending', 'reject', 'rejected', '否', '不通过') AND review_status IN ('active_rule', 'expert_verified', 'expert_verified_rule')")
def active_rules(spark, d):
    return infer.active_rules(rule_rows.build_rules(reviewed_rows(spark, d))).select("rule_id", "review_status")


@query(f"WITH {REVIEWED} SELECT 'P' || s_suppkey AS pattern_id, expert_decision FROM reviewed WHERE lower(trim(coalesce(expert_decision, 'accepted'))) NOT IN ('pending', 'reject', 'rejected', '否', '不通过')")
def accepted_rules(spark, d):
    return infer.accepted_rules(reviewed_rows(spark, d)).select("pattern_id", "expert_decision")


@query(f"""WITH {LARSEN}, f AS (SELECT source_id, consequent_entity, activation, a, b, c, d FROM larsen JOIN {values(SHAPES, "rule_id, a, b, c, d")} USING (rule_id) WHERE status = 'fired'),
g AS (SELECT source_id, consequent_entity, i, x, max(least(activation, CASE WHEN x < a OR x > d THEN 0 WHEN x >= b AND x <= c THEN 1 WHEN x < b THEN (x - a) / (b - a) ELSE (d - x) / (d - c) END)) AS y FROM f, (SELECT i, i / 49.0::DOUBLE AS x FROM range(50) AS g(i)) GROUP BY ALL),
s AS (SELECT source_id, consequent_entity, y, (y + lead(y) OVER w) / 2 * (lead(x) OVER w - x) AS ay, (x * y + lead(x) OVER w * lead(y) OVER w) / 2 * (lead(x) OVER w - x) AS ax FROM g WINDOW w AS (PARTITION BY source_id, consequent_entity ORDER BY i))
SELECT source_id, consequent_entity, round(CASE WHEN sum(ay) > 0 THEN sum(ax) / sum(ay) ELSE 0 END, 6) AS centroid, round(sum(ay), 6) AS area, round(max(y), 6) AS max_membership FROM s GROUP BY ALL""")
def mamdani_centroid(spark, d):
    shapes = spark.createDataFrame(SHAPES, "rule_id string, a double, b double, c double, d double")
    return infer.mamdani(fired_rows(spark, d), shapes, 50).select("source_id", "consequent_entity", "centroid", "area", "max_membership")


# --- aggregation ---


@query(f"WITH {SOURCE_LEVEL} SELECT source_id, consequent_entity, n_rules, membership, round(total_weight, 6) AS total_weight, tradition_id FROM source_level")
def agg_source(spark, d):
    return source_level(spark, d).select(
        "source_id", "consequent_entity", "n_rules", "membership", F.round("total_weight", 6).alias("total_weight"), "tradition_id"
    )


@query(f"WITH {SOURCE_LEVEL} SELECT tradition_id, consequent_entity, membership, evidence_count, source_count FROM tradition_level")
def agg_tradition(spark, d):
    return aggregate.by_tradition(source_level(spark, d))


@query(f"WITH {SOURCE_LEVEL} SELECT consequent_entity, membership, evidence_count, tradition_count FROM global_level")
def agg_global_noisy_or(spark, d):
    return global_level(spark, d).select("consequent_entity", "membership", "evidence_count", "tradition_count")


@query(f"WITH {SOURCE_LEVEL} SELECT 'source' AS level, source_id, tradition_id, consequent_entity, membership FROM source_level UNION ALL SELECT 'tradition', NULL, tradition_id, consequent_entity, membership FROM tradition_level UNION ALL SELECT 'global', NULL, NULL, consequent_entity, membership FROM global_level")
def agg_union_levels(spark, d):
    s = source_level(spark, d)
    tr = aggregate.by_tradition(s)
    whole = aggregate.noisy_or(tr, spark.createDataFrame([("ASIA", 0.5), ("EUROPE", 0.85)], "tradition_id string, delta double"))
    return aggregate.all_levels(s, tr, whole).select("level", "source_id", "tradition_id", "consequent_entity", "membership")


@query(f"""WITH {META}, c AS (SELECT 'tradition_id' AS dimension, tradition_id AS value FROM meta UNION ALL SELECT 'book_name', book_name FROM meta UNION ALL SELECT 'tags', unnest([tradition_id, book_name]) FROM meta)
SELECT dimension, coalesce(nullif(trim(value), ''), 'uncertain') AS value, count(*) AS n FROM c GROUP BY ALL""")
def stratification(spark, d):
    return aggregate.stratify(sources_meta(spark, d).withColumn("tags", F.array("tradition_id", "book_name")), ["tradition_id", "book_name"], ["tags"])


# --- mining ---


@query(f"WITH {BASKETS} SELECT source_id, string_agg(item, '|' ORDER BY item) AS items FROM baskets GROUP BY 1")
def itemsets_by_source(spark, d):
    return baskets(spark, d).groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list("item")), "|").alias("items"))


@query(f"WITH {BASKETS} SELECT item, n FROM singles")
def item_counts(spark, d):
    return mining.item_counts(baskets(spark, d))


def _patterns(size: int) -> str:
    names = "abcdef"[:size]
    joins = " ".join(f"JOIN baskets {n} ON {n}.source_id = a.source_id AND {p}.item < {n}.item" for p, n in zip(names, names[1:]))
    items = " || '|' || ".join(f"{n}.item" for n in names)
    counts = ", ".join(f"any_value(s{n}.n) AS n{n}" for n in names)
    singles = " ".join(f"JOIN singles s{n} ON s{n}.item = {n}.item" for n in names)
    lift = "support / (" + " * ".join(f"(n{n} / total)" for n in names) + ")"
    least, total = f"least({', '.join('n' + n for n in names)})", " + ".join("n" + n for n in names)
    return f"""SELECT items, {size} AS size, c AS source_count, round(support, 6) AS support, round({lift}, 6) AS lift, round(log2({lift}), 6) AS pmi, round(c / {least}, 6) AS confidence, round(c / greatest(1, {total} - c), 6) AS jaccard
FROM (SELECT {items} AS items, count(*) AS c, count(*) / any_value(total) AS support, any_value(total) AS total, {counts} FROM baskets a {joins} {singles}, total GROUP BY 1) WHERE c >= 5"""


def measured(spark, d, size):
    b = baskets(spark, d)
    n = t(spark, d, "orders").count()
    m = mining.pattern_metrics(mining.frequent_itemsets(b, 5, size), mining.item_counts(b), n)
    return m.select(
        F.array_join("items", "|").alias("items"), "size", "source_count",
        *[F.round(c, 6).alias(c) for c in ("support", "lift", "pmi", "confidence", "jaccard")]
    )


@query(f"WITH {BASKETS} {_patterns(2)}")
def pairs_metrics(spark, d):
    return measured(spark, d, 2)


@query(f"WITH {BASKETS} {_patterns(3)}")
def triples_metrics(spark, d):
    return measured(spark, d, 3).where("size = 3")


@query(f"WITH {BASKETS} SELECT items, size, source_count FROM (" + " UNION ALL ".join(_patterns(k) for k in (2, 3, 4, 5, 6)) + ")")
def apriori_levels(spark, d):
    return mining.frequent_itemsets(baskets(spark, d), 5).select(F.array_join("items", "|").alias("items"), "size", "source_count")


@query(f"WITH {BASKETS} SELECT items, size, source_count, lift FROM (" + " UNION ALL ".join(_patterns(k) for k in (2, 3)) + ") ORDER BY source_count DESC, lift DESC, items LIMIT 10")
def topk_patterns(spark, d):
    return measured(spark, d, 3).select("items", "size", "source_count", "lift").orderBy(F.desc("source_count"), F.desc("lift"), "items").limit(10)


@query(f"""WITH {BASKETS}, p AS (SELECT x.item AS a, y.item AS b, count(*)::DOUBLE AS k, any_value(s.n)::DOUBLE AS na, any_value(u.n)::DOUBLE AS nb, any_value(total) AS n FROM baskets x JOIN baskets y ON x.source_id = y.source_id AND x.item < y.item JOIN singles s ON s.item = x.item JOIN singles u ON u.item = y.item, total GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, k::BIGINT AS source_count, round(least(1, (SELECT sum(exp(lgamma(na + 1) - lgamma(i + 1) - lgamma(na - i + 1) + lgamma(n - na + 1) - lgamma(nb - i + 1) - lgamma(n - na - nb + i + 1) - lgamma(n + 1) + lgamma(nb + 1) + lgamma(n - nb + 1))) FROM unnest(range(k::BIGINT, least(na, nb)::BIGINT + 1)) AS g(i))), 6) AS fisher_p FROM p""")
def fisher_pairs(spark, d):
    b, n = baskets(spark, d), t(spark, d, "orders").count()
    s = mining.item_counts(b)
    p = mining.frequent_itemsets(b, 5, 2).select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "source_count")
    p = p.join(s.toDF("a", "na"), "a").join(s.toDF("b", "nb"), "b")
    return p.select(
        "a", "b", "source_count",
        F.round(mining.fisher_greater(*[F.col(c).cast("double") for c in ("source_count", "na", "nb")], F.lit(float(n))), 6).alias("fisher_p")
    )


ITEM_META = f"{BASKETS}, {META}, im AS (SELECT item, tradition_id, book_name FROM baskets JOIN meta USING (source_id))"


@query(f"WITH {ITEM_META}, n AS (SELECT item, tradition_id, count(*)::DOUBLE AS n FROM im GROUP BY ALL), s AS (SELECT item, sum(n) AS t, count(*) AS k, sum(n * ln(n)) AS nl FROM n GROUP BY 1) SELECT item, k AS distinct_values, round(CASE WHEN k <= 1 THEN 0 ELSE (ln(t) - nl / t) / ln(k) END, 6) AS entropy FROM s")
def tradition_entropy(spark, d):
    return mining.entropy(baskets(spark, d).join(sources_meta(spark, d), "source_id"), ["item"], "tradition_id")


@query(f"WITH {ITEM_META} SELECT item, count(DISTINCT book_name) AS books, count(DISTINCT tradition_id) AS traditions, round(count(DISTINCT book_name) / count(*), 6) AS source_diversity FROM im GROUP BY 1")
def source_diversity(spark, d):
    im = baskets(spark, d).join(sources_meta(spark, d), "source_id")
    return im.groupBy("item").agg(
        F.countDistinct("book_name").alias("books"), F.countDistinct("tradition_id").alias("traditions"),
        F.round(F.countDistinct("book_name") / F.count("*"), 6).alias("source_diversity")
    )


@query(f"WITH {STANDARD} SELECT standard_observation AS item, mapping_status AS status, count(*) AS n FROM std GROUP BY ALL")
def mapping_status_counts(spark, d):
    return extract.standardize(extracted(spark, d), MAPPING).groupBy(
        F.col("standard_observation").alias("item"),
        F.coalesce(F.nullif(F.trim("mapping_status"), F.lit("")), F.lit("unknown")).alias("status")
    ).agg(F.count("*").alias("n"))


@query(f"""WITH {STANDARD}, g AS (SELECT standard_observation AS pattern, doc_id, doc_id || ': ' || string_agg(evidence_text, '；' ORDER BY pattern_idx) AS txt FROM std GROUP BY standard_observation, doc_id), e AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS n FROM g)
SELECT pattern, string_agg(txt, ' / ' ORDER BY doc_id) AS evidence FROM e WHERE n <= 5 GROUP BY 1""")
def representative_evidence(spark, d):
    o = extract.standardize(extracted(spark, d), MAPPING)
    r = mining.representative_evidence(
        o.select(
            F.col("standard_observation").alias("pattern"), F.col("doc_id").alias("source_id"), F.col("pattern_idx").alias("seq"),
            F.col("evidence_text").alias("evidence")
        )
    )
    return r.select("pattern", F.array_join("evidence", " / ").alias("evidence"))


# --- calibration, evaluation, validation ---


@query("""SELECT event_type, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95,
round(CASE WHEN count(DISTINCT user_id) >= 2 THEN greatest(0, least(1, 1 - coalesce(stddev_samp(v), 0) / 0.5)) END, 6) AS icc, count(DISTINCT user_id) AS experts, count(*) AS n,
CASE WHEN count(DISTINCT user_id) >= 2 AND greatest(0, least(1, 1 - coalesce(stddev_samp(v), 0) / 0.5)) < 0.75 THEN 'low_agreement' ELSE 'calibrated' END AS review_status
FROM (SELECT event_type, user_id, greatest(0, least(1, value / 100)) AS v FROM events) GROUP BY 1""")
def calibration_stats(spark, d):
    return calibrate.calibration(t(spark, d, "events").select("event_type", "user_id", (F.col("value") / 100).alias("score")), ["event_type"], expert="user_id")


TASKS = "tasks AS (SELECT p_name AS term, p_type AS variable, 'high' AS fuzzy_set, min(least(1, p_retailprice / 2000)) AS prior FROM part GROUP BY ALL)"
ROLES = values([(k, v) for k, v in calibrate.ROLE_SHIFTS.items()], "expert_id, s")


def scoring_tasks(spark, d):
    """Names and kinds of parts as the lexicon's terms and variables."""
    p = t(spark, d, "part").groupBy(F.col("p_name").alias("term"), F.col("p_type").alias("variable")).agg(
        F.min(F.least(F.lit(1.0), F.col("p_retailprice") / 2000)).alias("prior_membership")
    )
    return p.select(
        "term", F.lit("part").alias("feature"), "variable", F.lit("high").alias("fuzzy_set"), "prior_membership",
        F.lit("bootstrap_prior").alias("current_status"), F.lit("pending").alias("review_status")
    )


@query(f"WITH {TASKS} SELECT term, variable, expert_id, round(greatest(0, least(1, prior + s)), 6) AS score FROM tasks, {ROLES}")
def panel_scores(spark, d):
    return calibrate.panel(scoring_tasks(spark, d), "prior_membership").select("term", "variable", "expert_id", "score")


PANEL = f"{TASKS}, scores AS (SELECT term, variable, round(greatest(0, least(1, prior + s)), 6) AS score FROM tasks, {ROLES}), done AS (SELECT term, variable, round(median(score), 6) AS prior_membership, round(greatest(0, least(1, 1 - stddev_samp(score) / 0.5)), 6) AS icc, count(*) AS score_count FROM scores GROUP BY ALL)"


@query(f"WITH {PANEL} SELECT term, variable, prior_membership, icc, CASE WHEN icc >= 0.75 THEN 'expert_calibrated' ELSE 'expert_calibrated_low_icc' END AS status, 'llm_roleplay_reviewed' AS review_status, 'llm_roleplay_panel' AS calibration_source, score_count FROM done")
def panel_calibration(spark, d):
    return calibrate.panel_calibration(scoring_tasks(spark, d)).select(
        "term", "variable", "prior_membership", "icc", "status", "review_status", "calibration_source", "score_count"
    )


@query(f"""WITH {TASKS}, e AS (SELECT p_name AS term, p_type AS variable, greatest(0, least(1, l_tax * 20)) AS score, l_suppkey AS expert FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT term, variable, round(median(score), 6) AS m, round(avg(score), 6) AS mean, count(*) AS n, round(CASE WHEN count(DISTINCT expert) >= 2 THEN greatest(0, least(1, 1 - coalesce(stddev_samp(score), 0) / 0.5)) END, 6) AS icc FROM e GROUP BY ALL)
SELECT term, variable, round(coalesce(m, prior), 6) AS prior_membership, mean AS expert_mean, CASE WHEN m IS NULL THEN 'bootstrap_prior' WHEN coalesce(icc, 1) >= 0.75 THEN 'expert_calibrated' ELSE 'expert_calibrated_low_icc' END AS status, CASE WHEN m IS NULL THEN 'pending' ELSE 'expert_reviewed' END AS review_status, n AS score_count FROM tasks LEFT JOIN r USING (term, variable)""")
def calibrated_lexicon(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("term"), F.col("p_type").alias("variable"))
    scores = t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "term", "variable", F.lit("high").alias("fuzzy_set"), F.col("l_suppkey").alias("expert_id"), (F.col("l_tax") * 20).alias("score")
    )
    r = calibrate.merge_calibration(scoring_tasks(spark, d), calibrate.calibration(calibrate.checked_scores(scores), ["term", "variable", "fuzzy_set"]))
    return r.select("term", "variable", F.round("prior_membership", 6).alias("prior_membership"), "expert_mean", "status", "review_status", "score_count")


@query(f"WITH o AS ({OBS}), lex AS (SELECT * FROM {LEX}), m AS (SELECT observation_id, feature_value, variable, fuzzy_set, membership, i FROM o JOIN lex ON term = CASE WHEN feature_value IN (SELECT term FROM lex) THEN feature_value ELSE standard_observation END) SELECT 'CAL_' || lpad(row_number() OVER (ORDER BY observation_id, variable)::VARCHAR, 6, '0') AS calibration_id, observation_id, feature_value, variable, membership AS model_membership FROM m")
def calibration_template(spark, d):
    o = observations(spark, d)
    m = membership.memberships(o, lexicon(spark)).withColumns(
        {c: F.lit(None).cast(k) for c, k in (("uncertainty_width", "double"), ("calculation_mode", "string"), ("status", "string"), ("icc", "double"))}
    )
    r = calibrate.calibration_template(m, o.withColumn("evidence_text", F.col("feature_value")), ["observation_id", "variable"])
    return r.select("calibration_id", "observation_id", "feature_value", "variable", "model_membership")


GOLD = f"gold AS (SELECT source_id, consequent_entity, expert FROM (SELECT l_orderkey AS source_id, 'bulk' AS consequent_entity, avg(l_tax) * 10 AS expert FROM lineitem GROUP BY 1))"


def gold(spark, d):
    return t(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("source_id")
    ).agg((F.avg("l_tax") * 10).alias("expert")).withColumn("consequent_entity", F.lit("bulk"))


@query(f"WITH {SOURCE_LEVEL}, {GOLD} SELECT 'FCR' AS metric, round(greatest(0, least(1, 1 - avg(abs(membership - expert)))), 5) AS value, count(*) AS n FROM source_level JOIN gold USING (source_id, consequent_entity)")
def fcr(spark, d):
    return evaluate.agreement(
        source_level(spark, d), gold(spark, d), ["source_id", "consequent_entity"], "FCR"
    ).select("metric", F.round("value", 5).alias("value"), "n")


@query(f"WITH {LARSEN}, {GOLD}, m AS (SELECT source_id, consequent_entity, arg_max(activation, rule_id) AS membership FROM larsen WHERE status = 'fired' GROUP BY ALL) SELECT 'FIA-local' AS metric, round(greatest(0, least(1, 1 - avg(abs(membership - expert)))), 5) AS value, count(*) AS n FROM m JOIN gold USING (source_id, consequent_entity)")
def fia_local(spark, d):
    last = infer.last_of(fired_rows(spark, d), ["source_id", "consequent_entity"], "rule_id").withColumnRenamed("activation", "membership")
    return evaluate.agreement(last, gold(spark, d), ["source_id", "consequent_entity"], "FIA-local").select("metric", F.round("value", 5).alias("value"), "n")


@query(f"WITH {LARSEN}, p AS (SELECT source_id, list(DISTINCT consequent_entity) AS predicted FROM larsen WHERE status = 'fired' GROUP BY 1) SELECT 'MIC' AS metric, round(avg(coalesce(len(list_intersect(predicted, ['bulk', 'returned'])), 0) / 2), 5) AS value, count(*) AS n FROM orders LEFT JOIN p ON o_orderkey = source_id")
def mic(spark, d):
    p = fired_rows(spark, d).groupBy("source_id").agg(F.collect_set("consequent_entity").alias("predicted"))
    g = t(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), S.split_set(F.lit("bulk;returned|bulk")).alias("expected"))
    return evaluate.overlap_with(p, g, "source_id", "MIC").select("metric", F.round("value", 5).alias("value"), "n")


@query("SELECT 'CRP' AS metric, round(greatest(0, least(1, 1 - avg(abs(l_tax - l_discount)))), 6) AS value, count(*) AS n FROM lineitem")
def crp(spark, d):
    return evaluate.metric(
        t(spark, d, "lineitem"), "CRP", 1 - F.avg(F.abs(F.col("l_tax") - F.col("l_discount"))), "1 - mean|model - expert|"
    ).select("metric", "value", "n")


@query(f"WITH {LARSEN} SELECT round(avg(k), 6) AS value, count(*) AS n FROM (SELECT count(DISTINCT consequent_entity) AS k FROM larsen WHERE status = 'fired' GROUP BY source_id)")
def multi_interpretation(spark, d):
    return evaluate.interpretations(fired_rows(spark, d))


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, d):
    return validate.duplicates(t(spark, d, "orders"), "o_custkey")


UNC = "SELECT doc_id AS id, unnest(list_filter([CASE WHEN coalesce(nullif(trim(nullif(lang, 'de')), ''), 'uncertain') = 'uncertain' THEN 'lang' END, CASE WHEN coalesce(nullif(trim(nullif(source, 'src3')), ''), 'uncertain') = 'uncertain' THEN 'source' END], lambda x: x IS NOT NULL)) AS field FROM documents"


def uncertain(spark, d):
    docs = t(spark, d, "documents").select(
        "doc_id", F.nullif("lang", F.lit("de")).alias("lang"), F.when(F.col("source") != "src3", F.col("source")).alias("source")
    )
    return validate.uncertain_metadata(docs, "doc_id", ["lang", "source"])


@query(UNC)
def uncertain_metadata(spark, d):
    return uncertain(spark, d)


@query(f"SELECT 0::BIGINT AS errors, count(*) AS warnings, CASE WHEN count(*) > 0 THEN 'exploratory_ready' ELSE 'formal_ready' END AS overall FROM ({UNC})")
def overall_readiness(spark, d):
    """All errors, and the warnings that the SQL counts: uncertain metadata, and
    a small sample, which no table at hand is."""
    docs = t(spark, d, "documents")
    found = validate.union(
        validate.source_findings(docs, "doc_id", ["text"], uncertain(spark, d)),
        validate.fewer_than(extracted(spark, d), 1, "error", "no_observations"),
        validate.sample_findings(docs),
        validate.rule_errors(rules(spark)),
    )
    return validate.readiness(found)


# --- network ---

MEMBERS_OF = f"o AS ({OBS}), lex AS (SELECT * FROM {LEX}), m AS (SELECT observation_id, standard_observation, variable || '.' || fuzzy_set AS key, membership FROM o JOIN lex ON term = CASE WHEN feature_value IN (SELECT term FROM lex) THEN feature_value ELSE standard_observation END)"


def relations(spark, d):
    o = observations(spark, d).withColumns({"extraction_confidence": F.lit(1.0), "evidence_text": F.col("feature_value")})
    m = membership.memberships(o, lexicon(spark)).withColumns(
        {"variable_key": S.variable_key(F.col("variable"), F.col("fuzzy_set")), "membership_id": F.col("observation_id").cast("string")}
    )
    fired = written(fired_rows(spark, d), "fired")
    return network.relation_network(
        o, m, rules(spark).withColumn("rule_name", F.concat(F.lit("rule "), "rule_id")), fired, global_level(spark, d, fired)
    )


@query(f"""WITH {SOURCE_LEVEL}, {MEMBERS_OF}
SELECT DISTINCT 'source:' || source_id AS node_id, 'source' AS node_type, source_id::VARCHAR AS label, NULL::VARCHAR AS rule_name FROM o UNION ALL SELECT DISTINCT 'observation:' || standard_observation, 'observation', standard_observation, NULL FROM o
UNION ALL SELECT 'fuzzy_variable:' || key, 'fuzzy_variable', key, NULL FROM (SELECT key FROM m UNION SELECT key FROM ants) UNION ALL SELECT 'rule:' || rule_id, 'rule', rule_id, 'rule ' || rule_id FROM rules
UNION ALL SELECT DISTINCT 'conclusion:' || consequent_entity, consequent_type, consequent_entity, NULL FROM rules UNION ALL SELECT 'global:' || consequent_entity, 'global_conclusion', consequent_entity, NULL FROM global_level""")
def network_nodes(spark, d):
    return relations(spark, d)[0]


@query(f"""WITH {SOURCE_LEVEL}, {MEMBERS_OF}
SELECT 'source:' || source_id AS source, 'observation:' || standard_observation AS target, 'contains_observation' AS edge_type, 1.0::DOUBLE AS weight, feature_value AS evidence, NULL::DOUBLE AS threshold, NULL::VARCHAR AS review_status FROM o
UNION ALL SELECT 'observation:' || standard_observation, 'fuzzy_variable:' || key, 'maps_to_membership', membership, observation_id::VARCHAR, NULL, NULL FROM m
UNION ALL SELECT 'fuzzy_variable:' || key, 'rule:' || rule_id, 'antecedent_of', weight, NULL, threshold, NULL FROM ants UNION ALL SELECT 'rule:' || rule_id, 'conclusion:' || consequent_entity, 'infers', rule_weight, NULL, NULL, review_status FROM rules
UNION ALL SELECT 'source:' || l.source_id, 'rule:' || rule_id, 'activates_rule', activation, coalesce((SELECT string_agg(key, ';' ORDER BY i) FROM ants a WHERE a.rule_id = l.rule_id), ''), NULL, NULL FROM larsen l WHERE status = 'fired'
UNION ALL SELECT 'conclusion:' || consequent_entity, 'global:' || consequent_entity, 'aggregates_to_global', membership, evidence_count::VARCHAR, NULL, NULL FROM global_level""")
def network_edges(spark, d):
    return relations(spark, d)[1]


# --- resumable extraction ---


def chunk_log(spark, d):
    """Turns of conversations as log records of three chunks a conversation."""
    c = t(spark, d, "conversations")
    return c.select(
        F.col("conv_id").alias("source_id"), (F.col("turn") % 3).cast("int").alias("chunk_index"), F.col("turn").alias("seq"),
        F.md5(F.col("text").cast("binary")).alias("chunk_sha256"),
        F.when(F.col("role") == "user", "success").otherwise("error").alias("status"), F.col("text").alias("error")
    )


LOG = "log AS (SELECT conv_id AS source_id, (turn % 3)::INT AS chunk_index, turn AS seq, md5(text) AS chunk_sha256, CASE WHEN role = 'user' THEN 'success' ELSE 'error' END AS status, text AS error FROM conversations), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index ORDER BY (status = 'success') DESC, seq DESC, chunk_sha256 DESC) AS n FROM log) WHERE n = 1)"


@query(f"WITH {LOG} SELECT source_id, chunk_index, seq, status, chunk_sha256 FROM latest")
def chunk_latest(spark, d):
    return chunks.latest_records(chunk_log(spark, d)).select("source_id", "chunk_index", "seq", "status", "chunk_sha256")


def log_files(spark, d) -> str:
    """Turns of conversations as files of JSON lines, in order of turn and
    without a number; of each fifth conversation's lines there is also a torn one."""
    c = t(spark, d, "conversations").orderBy("turn", "conv_id")
    ok = F.col("role") == "user"
    one = F.struct(
        F.lit("f").alias("feature"), F.col("role").alias("feature_value"), F.lit("e").alias("evidence_text"),
        F.lit(0.5).alias("extraction_confidence")
    )
    record = F.to_json(F.struct(
        F.col("conv_id").alias("source_id"), (F.col("turn") % 3 + 1).alias("chunk_index"), F.md5(F.col("text").cast("binary")).alias("chunk_sha256"),
        F.when(ok, "success").otherwise("error").alias("status"), F.when(ok, F.array(one)).otherwise(F.array()).alias("observations"),
        F.when(ok, F.lit("")).alias("attempt"), F.when(~ok, F.col("text")).alias("error")))
    torn = F.substring(record, F.lit(1), F.length(record) - 7)
    lines = F.when(F.col("conv_id") % 5 == 0, F.array(record, torn)).otherwise(F.array(record))
    path = new_path(spark, "log")
    c.select(F.explode(lines).alias("value")).write.text(path)
    return path


LOGGED = "SELECT conv_id::VARCHAR AS source_id, (turn % 3 + 1)::INT AS chunk_index, role, md5(text) AS chunk_sha256, CASE WHEN role = 'user' THEN 'success' ELSE 'error' END AS status, turn, CASE WHEN role <> 'user' THEN text END AS error FROM conversations"
LAST_LOGGED = f"SELECT source_id, chunk_index, chunk_sha256, status, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS found, md5(error) AS error FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_index ORDER BY (status = 'success') DESC, turn DESC) AS n FROM ({LOGGED})) WHERE n = 1"


def last_logged(r: DataFrame) -> DataFrame:
    return r.select("source_id", "chunk_index", "chunk_sha256", "status", F.size("observations").alias("found"), F.md5("error").alias("error"))


@query(LAST_LOGGED)
def log_latest(spark, d):
    """A log read from files that tell no order but their own."""
    return last_logged(chunks.latest_records(logs.read_log(spark, log_files(spark, d))))


@query(LAST_LOGGED)
def log_state(spark, d):
    """The same log as a stream, from the state that it leaves."""
    checkpoint = new_path(spark, "log-state")
    logs.keep_latest(logs.stream_log(spark, log_files(spark, d)), checkpoint).awaitTermination()
    return last_logged(logs.current(spark, checkpoint))


@query("""WITH latest AS (SELECT conv_id, chunk_index, turn FROM (SELECT conv_id, turn % 3 + 1 AS chunk_index, turn, role, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY role = 'user' DESC, turn DESC) AS n FROM conversations) WHERE n = 1 AND role = 'user'),
found AS (SELECT conv_id, chunk_index, 0 AS row, 'v' || turn % 2 AS feature_value, 1.0 AS confidence FROM latest UNION ALL SELECT conv_id, chunk_index, 1, 'same', 0.5 FROM latest),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, feature_value ORDER BY chunk_index, row) AS n FROM found) WHERE n = 1)
SELECT 'OBS_' || lpad(row_number() OVER (ORDER BY conv_id DESC, chunk_index, row)::VARCHAR, 6, '0') AS observation_id, conv_id AS source_id, chunk_index::INT AS chunk_index, feature_value, confidence::DOUBLE AS confidence FROM kept""")
def assembled_observations(spark, d):
    """Observations of a log's successful chunks, numbered in order of the sources."""
    c = t(spark, d, "conversations")
    row = lambda value, confidence: F.struct(
        F.lit("f").alias("feature"), value.alias("feature_value"), F.lit("e").alias("evidence_text"),
        F.lit(confidence).alias("extraction_confidence")
    )
    found = F.array(row(F.concat(F.lit("v"), F.col("turn") % 2), "7"), row(F.lit("same"), "much"))
    log = c.select(
        F.col("conv_id").alias("source_id"), (F.col("turn") % 3 + 1).cast("int").alias("chunk_index"), F.col("turn").alias("seq"),
        F.lit("h").alias("chunk_sha256"), F.when(F.col("role") == "user", "success").otherwise("error").alias("status"),
        found.alias("observations")
    )
    sources = c.select(F.col("conv_id").alias("source_id"), (-F.col("conv_id")).alias("source_seq")).distinct()
    return chunks.assemble_numbered(log, sources).select(
        "observation_id", "source_id", "chunk_index", "feature_value", F.col("extraction_confidence").alias("confidence")
    )


def planned(spark, d):
    return chunk_log(spark, d).select("source_id", "chunk_index", "chunk_sha256").distinct()


@query(f"WITH {LOG} SELECT DISTINCT source_id, chunk_index, chunk_sha256 FROM log WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.status = 'success' AND l.source_id = log.source_id AND l.chunk_index = log.chunk_index AND l.chunk_sha256 = log.chunk_sha256)")
def chunk_pending(spark, d):
    return chunks.pending_chunks(planned(spark, d), chunk_log(spark, d))


@query(f"""WITH {LOG}, p AS (SELECT source_id, count(*) AS chunks FROM (SELECT DISTINCT source_id, chunk_index, chunk_sha256 FROM log) GROUP BY 1)
SELECT source_id, any_value(chunks) AS chunks, count(*) FILTER (WHERE status = 'success') AS ok, count(*) FILTER (WHERE status <> 'success') AS failed,
CASE WHEN count(*) FILTER (WHERE status = 'success') > 0 AND count(*) FILTER (WHERE status <> 'success') > 0 THEN 'partial_success' WHEN count(*) FILTER (WHERE status <> 'success') > 0 THEN 'error' ELSE 'success' END AS status,
substring(coalesce(string_agg(substring(error, 1, 300), ' | ' ORDER BY chunk_index) FILTER (WHERE status <> 'success'), ''), 1, 1000) AS errors FROM latest JOIN p USING (source_id) GROUP BY 1""")
def source_progress(spark, d):
    return chunks.source_progress(planned(spark, d), chunk_log(spark, d))


@query(r"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL), cut AS (
  SELECT doc_id, 0 AS a, CASE WHEN length(text) <= 1800 THEN length(text) END AS b, length(text) AS n, 0 AS k FROM docs WHERE text <> ''
  UNION ALL SELECT doc_id, CASE WHEN b IS NULL THEN a ELSE greatest(a + 1, b - 80) END, CASE WHEN b IS NULL THEN e WHEN n - greatest(a + 1, b - 80) <= 1800 THEN n END, n, k + 1
  FROM (SELECT c.*, CASE WHEN b IS NULL THEN a + 600 + CASE WHEN contains(seg, chr(10)) THEN length(regexp_extract(seg, '(?s)^(.*)\n', 1)) WHEN regexp_matches(seg, '[。；;.]') THEN length(regexp_extract(seg, '(?s)^.*[。；;.]')) ELSE 1200 END END AS e
    FROM (SELECT cut.*, CASE WHEN b IS NULL THEN substring(text, a + 601, 1200) END AS seg FROM cut JOIN docs USING (doc_id) WHERE b IS NULL OR b < n) c)
), spans AS (SELECT doc_id, a, regexp_replace(substring(text, a + 1, b - a), '^\s+|\s+$', '', 'g') AS chunk FROM cut JOIN docs USING (doc_id) WHERE b IS NOT NULL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a))::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_total, chunk, sha256(chunk) AS chunk_sha256 FROM spans WHERE chunk <> ''""")
def split_text_chunks(spark, d):
    return chunks.plan_chunks(t(spark, d, "documents"), "doc_id", size=1800, overlap=80)


@query(ORACLES["split_text_chunks"])
def split_text_sql(spark, d):
    """The same by a function that SQL calls for each text."""
    table_functions.register(spark)
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL split_chunks(d.text, 1800, 80) c", docs=t(spark, d, "documents"))


@query(f"WITH {EXTRACT} SELECT * FROM found")
def find_patterns_sql(spark, d):
    """The extraction by a function that SQL calls for each text."""
    table_functions.register(spark)
    patterns = json.dumps(PATTERNS)
    return spark.sql(f"SELECT d.doc_id, f.* FROM {{docs}} d, LATERAL find_patterns(d.text, '{patterns}') f", docs=t(spark, d, "documents"))


@query("SELECT event_id, 0 AS row, 'kind' AS feature, event_type AS feature_value, '' AS evidence_text, 1.0::DOUBLE AS extraction_confidence FROM events")
def json_recovery(spark, d):
    e = t(spark, d, "events").select(
        "event_id",
        F.concat(
            F.lit("<think>no</think>```json\n{\"items\": [{\"feature\": \"kind\", \"feature_value\": \""), F.col("event_type"),
            F.lit("\", \"extraction_confidence\": 2},]}\n```")
        ).alias("answer")
    )
    return extract.answers_to_rows(e, ["kind"])


# --- scalars ---


@query("SELECT p_partkey, lower(trim(p_type)) || ':' || lower(p_brand) AS item FROM part")
def nfkc_items(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_type"), F.lit(" : "), F.col("p_brand")).alias("raw"))
    names = p.select("raw").distinct().select("raw", S.normal_item(F.col("raw")).alias("item"))
    return p.join(names, "raw").select("p_partkey", "item")


@query("SELECT p_partkey, p_type || '+' || p_brand || ',x' AS tags FROM part")
def split_tags(spark, d):
    return t(spark, d, "part").select(
        "p_partkey", F.array_join(S.split_tags(F.concat(F.lit(" "), "p_type", F.lit("; "), "p_brand", F.lit(",x ;"))), "+").alias("tags")
    )


@query("SELECT p_partkey, p_type || '+' || p_brand AS tags FROM part WHERE p_type <> p_brand")
def split_set(spark, d):
    return t(spark, d, "part").where("p_type <> p_brand").select(
        "p_partkey", F.array_join(S.split_set(F.concat("p_type", F.lit("，"), "p_brand", F.lit("|"), "p_type")), "+").alias("tags")
    )


@query("SELECT page_id, replace(replace(replace(replace(url, ':', '_'), '/', '_'), chr(92), '_'), ' ', '_') AS file FROM pages")
def safe_filename(spark, d):
    return t(spark, d, "pages").select("page_id", S.safe_filename(F.col("url")).alias("file"))


@query("SELECT event_id, greatest(0.0, least(1.0, value / 50)) AS unit, 0.25::DOUBLE AS other FROM events")
def clamp01(spark, d):
    return t(spark, d, "events").select(
        "event_id", S.clamp01((F.col("value") / 50).cast("string")).alias("unit"), S.clamp01(F.col("event_type"), 0.25).alias("other")
    )


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Documents to conclusions: patterns, standard names, memberships, rules,
    sources, traditions, corpus."""
    docs = t(spark, d, "documents")
    o = extract.standardize(extract.extract_by_patterns(docs.select(F.col("doc_id").alias("source_id"), "text"), PATTERNS), MAPPING)
    lex = spark.createDataFrame(
        [("english", "language", "english", 0.9, None, None), ("que", "ending", "romance", 0.7, 0.6, 0.8), ("tion", "ending", "latin", 0.8, None, None)],
        lexicon(spark).schema
    )
    m = membership.memberships(o, lex).select(
        "source_id", S.variable_key(F.col("variable"), F.col("fuzzy_set")).alias("variable_key"), F.col("pattern_idx").alias("seq"),
        "membership", "p5", "p95"
    )
    r = spark.createDataFrame(
        [
            ("D1", "prose", "kind", 0.9, None, "active_rule", None, [("language", "english", 0.5, 0.6), ("ending", "latin", 0.5, 0.4)]),
            ("D2", "romance", "kind", 0.8, None, "active_rule", None, [("ending", "romance", 0.5, 1.0)])
        ],
        rules(spark).schema
    )
    fired = infer.larsen(infer.best_memberships(m), r).where("status = 'fired'")
    meta = docs.select(F.col("doc_id").alias("source_id"), F.col("lang").alias("tradition_id"), F.lit(0.8).alias("quality_weight"))
    traditions = aggregate.by_tradition(aggregate.by_source(fired, r, meta))
    return aggregate.noisy_or(traditions, spark.createDataFrame([("en", 0.5)], "tradition_id string, delta double"))


@query(f"""WITH {EXTRACT}, has AS (SELECT doc_id, max(0.9) FILTER (WHERE feature_value = 'english') AS e, max(0.7) FILTER (WHERE feature_value = 'que') AS q, max(0.8) FILTER (WHERE feature_value = 'tion') AS l FROM found GROUP BY 1), fired AS (
  SELECT doc_id, 'prose' AS consequent_entity, round(0.9 * pow(e, 0.6) * pow(l, 0.4), 6) AS mu FROM has WHERE e >= 0.5 AND l >= 0.5 UNION ALL SELECT doc_id, 'romance', round(0.8 * q, 6) FROM has WHERE q >= 0.5
), tr AS (SELECT lang, consequent_entity, round(avg(mu), 6) AS mu, count(*) AS n, CASE WHEN lang = 'en' THEN 0.5 ELSE 1.0 END AS delta FROM fired JOIN documents USING (doc_id) GROUP BY ALL)
SELECT consequent_entity, round(greatest(0, least(1, 1 - product(1 - delta * mu))), 6) AS membership, sum(n)::BIGINT AS evidence_count, count(*) AS tradition_count, string_agg(delta::DOUBLE::VARCHAR, ',' ORDER BY lang) AS delta_values FROM tr GROUP BY 1""")
def documents_to_conclusions(spark, d):
    return entry(spark, d).withColumn("delta_values", F.array_join(F.transform("delta_values", lambda x: x.cast("string")), ","))


# --- rules, patterns and reports of a build ---


PATTERN_CONFIG = {
    "max_size": 3, "min_support": 0.005, "min_lift": 0.9, "min_pmi": -1.0, "min_source_count": 5, "min_tradition_count": 2,
    "max_source_ids_per_pattern": 7
}


def part_observations(spark, d):
    """Kinds of parts as observations of their orders."""
    p = beside(t(spark, d, "part").select("p_partkey", "p_type", "p_brand"))
    status = F.when(F.col("l_linenumber") % 2 == 1, "mapped").otherwise("")
    return t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("source_id"), F.concat(F.lit(" "), F.upper("p_type")).alias("observation_key"),
        status.alias("mapping_status"), F.col("p_brand").alias("evidence_text"), F.col("l_linenumber").alias("seq")
    )


def mined(spark, d):
    return patterns.mine_patterns(part_observations(spark, d), sources_meta(spark, d), PATTERN_CONFIG)


MINED = f"""{META}, total AS (SELECT count(*)::DOUBLE AS total FROM orders), baskets AS (SELECT DISTINCT l_orderkey AS source_id, lower(p_type) AS item FROM lineitem JOIN part ON l_partkey = p_partkey), singles AS (SELECT item, count(*) AS n FROM baskets GROUP BY 1), occ AS (
  SELECT a.source_id, [a.item, b.item] AS items FROM baskets a JOIN baskets b ON a.source_id = b.source_id AND a.item < b.item UNION ALL SELECT a.source_id, [a.item, b.item, c.item] FROM baskets a JOIN baskets b ON a.source_id = b.source_id AND a.item < b.item JOIN baskets c ON a.source_id = c.source_id AND b.item < c.item
), counted AS (SELECT items, len(items) AS size, count(*) AS c, count(DISTINCT book_name) AS book_count, count(DISTINCT tradition_id) AS tradition_count FROM occ JOIN meta USING (source_id) GROUP BY items), chances AS (
  SELECT items, product(n / total) AS chance, min(n) AS least, sum(n) AS s FROM (SELECT DISTINCT items, unnest(items) AS item FROM counted) JOIN singles USING (item), total GROUP BY items
), kept AS (SELECT counted.*, c / total AS support, c / total / chance AS lift, c / least AS confidence, c / greatest(1, s - c) AS jaccard FROM counted JOIN chances USING (items), total WHERE c >= greatest(5, ceil(total * 0.005)) AND c / total / chance >= 0.9 AND log2(c / total / chance) >= -1 AND tradition_count >= 2
), mined AS (SELECT *, 'PATTERN_' || lpad(row_number() OVER (ORDER BY c DESC, lift DESC, size, items)::VARCHAR, 6, '0') AS pattern_id FROM kept)"""


@query(f"""WITH {MINED}, tn AS (SELECT items, tradition_id, count(*)::DOUBLE AS n FROM occ JOIN meta USING (source_id) GROUP BY ALL), te AS (SELECT items, CASE WHEN count(*) <= 1 THEN 0 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) END AS entropy FROM tn GROUP BY 1), ids AS (SELECT items, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY items ORDER BY source_id) AS k FROM occ) WHERE k <= 7 GROUP BY 1)
SELECT pattern_id, array_to_string(items, '|') AS items, size::INT AS size, c AS source_count, round(support, 6) AS support, round(lift, 6) AS lift, round(log2(lift), 6) AS pmi, round(confidence, 6) AS confidence, round(jaccard, 6) AS jaccard, book_count, tradition_count, round(book_count / c, 6) AS source_diversity, round(entropy, 6) AS tradition_entropy, ids AS source_ids, 'pending' AS review_status FROM mined JOIN te USING (items) JOIN ids USING (items)""")
def mined_patterns(spark, d):
    m = mined(spark, d)
    return m.select(
        "pattern_id", F.array_join("items", "|").alias("items"), "size", "source_count", "support", "lift", "pmi", "confidence", "jaccard",
        "book_count", "tradition_count", "source_diversity", "tradition_entropy",
        F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("source_ids"), "review_status"
    )


@query(f"""WITH {MINED}, ev AS (SELECT pattern_id, source_id, list_position(items, lower(p_type)) AS pos, l_linenumber AS seq, p_brand FROM mined JOIN occ USING (items) JOIN lineitem ON l_orderkey = source_id JOIN part ON l_partkey = p_partkey WHERE list_contains(items, lower(p_type))), firsts AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY pattern_id ORDER BY source_id) AS k FROM ev) WHERE k <= 5), uniq AS (SELECT pattern_id, source_id, p_brand, min(pos * 1000 + seq) AS o FROM firsts GROUP BY ALL), txt AS (SELECT pattern_id, source_id, source_id || ': ' || string_agg(p_brand, '；' ORDER BY o, p_brand) AS txt FROM uniq GROUP BY pattern_id, source_id)
SELECT pattern_id, string_agg(txt, ' / ' ORDER BY source_id) AS evidence FROM txt GROUP BY 1""")
def pattern_evidence(spark, d):
    return mined(spark, d).select("pattern_id", F.array_join("representative_evidence", " / ").alias("evidence"))


@query(f"WITH {MINED}, s AS (SELECT lower(p_type) AS item, CASE WHEN l_linenumber % 2 = 1 THEN 'mapped' ELSE 'unknown' END AS status, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN meta ON source_id = l_orderkey GROUP BY ALL) SELECT pattern_id, item, status, n FROM (SELECT pattern_id, unnest(items) AS item FROM mined) JOIN s USING (item)")
def pattern_mapping_status(spark, d):
    m = mined(spark, d).select("pattern_id", F.explode("mapping_status_summary").alias("item", "counts"))
    return m.select("pattern_id", "item", F.explode("counts").alias("status", "n"))


@query(f"WITH {MINED}, e AS (SELECT unnest(items) AS item, pattern_id, round(lift, 6) AS lift, c FROM mined) SELECT item, pattern_id, place FROM (SELECT *, (row_number() OVER (PARTITION BY item ORDER BY lift DESC, c DESC, pattern_id))::INT AS place FROM e) WHERE place <= 10")
def patterns_of_items(spark, d):
    return report.patterns_of_items(mined(spark, d)).select("item", "pattern_id", "place")


@query(f"WITH {MINED}, {REVIEWED} SELECT pattern_id AS artifact_id, 'candidate_pattern' AS artifact_type, 'pending' AS lifecycle_state, 'observation_itemset' AS created_from, 'expert_reviewed_pattern' AS next_expected_state FROM mined UNION ALL SELECT rule_id, 'rule', review_status, 'P' || s_suppkey, CASE WHEN review_status = 'expert_verified' THEN 'active_rule' ELSE 'expert_review_or_monitoring' END FROM reviewed WHERE has_antecedents AND consequent_entity IS NOT NULL AND lower(trim(coalesce(expert_decision, 'accepted'))) NOT IN ('pending', 'reject', 'rejected', '否', '不通过')")
def rule_lifecycle(spark, d):
    return rule_rows.lifecycle(mined(spark, d), rule_rows.build_rules(reviewed_rows(spark, d))).select(
        "artifact_id", "artifact_type", "lifecycle_state", "created_from", "next_expected_state"
    )


@query(f"WITH {MINED} SELECT pattern_id, size::INT AS size, 'pending' AS expert_decision, '[]' AS antecedents_json, '' AS suggested_consequent, 'pending' AS review_status FROM mined")
def review_template(spark, d):
    return rule_rows.review_template(mined(spark, d)).select(
        "pattern_id", "size", "expert_decision", "antecedents_json", "suggested_consequent", "review_status"
    )


def chapter_rows(spark, d):
    """Documents under other names, as a table to be normalized."""
    return t(spark, d, "documents").select(
        F.concat(F.lit("D"), "doc_id").alias("编号"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("Book"),
        (F.col("n_chars") + 0.5).cast("string").alias("序号"), F.when(F.col("doc_id") % 10 > 0, F.col("text")).otherwise(" ").alias("正文"),
        F.col("lang").alias("学术传统"), F.lit("x").alias("other")
    )


@query("SELECT 'D' || doc_id AS source_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE 'corpus' END AS book_name, n_chars::INT AS chapter_order, '古籍章节' AS text_type, lang AS tradition_id, 0.8::DOUBLE AS source_authority, md5(trim(text)) AS text FROM documents WHERE doc_id % 10 > 0 AND trim(text) <> ''")
def normalized_chapters(spark, d):
    kept, _ = tables.normalize(chapter_rows(spark, d), "corpus")
    return kept.select(
        "source_id", "book_name", "chapter_order", "text_type", "tradition_id", "source_authority",
        F.md5(F.col("text_original").cast("binary")).alias("text")
    )


@query("SELECT 'D' || doc_id AS source_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, 'uncertain') AS book_name, n_chars::INT AS chapter_order, lang AS tradition_id, 0.5::DOUBLE AS quality, length(CASE WHEN doc_id % 10 > 0 THEN trim(text) ELSE '' END) AS chars FROM documents")
def source_metadata(spark, d):
    c = tables.chapters(chapter_rows(spark, d).withColumnRenamed("Book", "book").withColumnRenamed("学术传统", "传统"))
    return c.select(
        "source_id", "book_name", "chapter_order", "tradition_id", F.round("quality", 6).alias("quality"),
        F.length(extract.chosen_text()).cast("long").alias("chars")
    )


@query("SELECT tradition, line, count(*) AS n FROM (SELECT coalesce(lang, 'uncertain') AS tradition, '- ' || source || ' ' || n_chars AS line FROM documents) GROUP BY ALL")
def tradition_pages(spark, d):
    """Lines of the traditions' pages; long lists take several pages."""
    src = t(spark, d, "documents").select(
        F.coalesce("lang", F.lit("uncertain")).alias("tradition_id"), F.col("source").alias("book_name"),
        F.col("n_chars").cast("string").alias("chapter_title"), F.col("doc_id").alias("source_id")
    )
    levels = spark.createDataFrame([], "level string, tradition_id string, consequent_entity string, membership double, evidence_count long")
    lines = report.tradition_pages(src, levels).select(
        F.regexp_extract("path", "traditions/([a-z]+)", 1).alias("tradition"), F.explode(F.split("body", "\n")).alias("line")
    )
    return lines.where("line LIKE '- %'").groupBy("tradition", "line").agg(F.count("*").alias("n"))


@query("SELECT 'SMB' AS metric, round(avg(CASE WHEN known THEN 0.5 ELSE 0 END), 6) AS value, count(*) AS n FROM (SELECT p_partkey % 4 > 0 AS known FROM part)")
def smb(spark, d):
    p = t(spark, d, "part")
    entities = p.where("p_partkey % 4 > 0").select(
        F.col("p_partkey").cast("string").alias("entity_name"), F.concat("p_type", F.lit("；"), "p_brand").alias("modern_mapping")
    )
    return evaluate.mapping_overlap(
        entities,
        p.select(F.col("p_partkey").cast("string").alias("entity_name"), F.concat("p_type", F.lit(" | none")).alias("expected_modern_mapping"))
    ).select("metric", "value", "n")


@query("SELECT 'SMB-coverage-proxy' AS metric, round(count(*) FILTER (WHERE p_partkey % 4 > 0) / count(*), 6) AS value, count(*) AS n, 'proxy' AS status FROM part")
def smb_coverage(spark, d):
    return evaluate.mapping_coverage(
        t(spark, d, "part").select(F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).otherwise(" ").alias("modern_mapping"))
    ).select("metric", "value", "n", "status")


@query("SELECT 'FIA-chain' AS metric, round(avg(l_discount * 5), 6) AS value, count(*) AS n FROM lineitem WHERE l_linenumber < 7")
def fia_chain(spark, d):
    return evaluate.chain_overlap(
        t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_discount") * 5).alias("path_overlap"))
    ).select("metric", "value", "n")


def logged(spark, d):
    return chunk_log(spark, d).withColumns(
        {"attempt": F.lit(1), "observations": F.array_repeat(F.struct(F.lit("f").alias("feature")), (F.col("seq") % 4).cast("int"))}
    )


@query(f"WITH {LOG} SELECT source_id, chunk_index, error FROM latest WHERE status <> 'success'")
def chunk_errors(spark, d):
    return chunks.errors(chunks.latest_records(logged(spark, d))).select("source_id", "chunk_index", "error")


@query(f"WITH {LOG}, p AS (SELECT DISTINCT source_id, chunk_index, chunk_sha256 FROM log) SELECT count(DISTINCT p.source_id) AS sources, count(*) AS chunks, count(*) FILTER (WHERE status = 'success') AS done, count(*) FILTER (WHERE status <> 'success') AS failed, 0::BIGINT AS pending, coalesce(sum(seq % 4) FILTER (WHERE status = 'success'), 0)::BIGINT AS observations FROM p JOIN latest USING (source_id, chunk_index)")
def extraction_report(spark, d):
    return chunks.extraction_report(planned(spark, d), logged(spark, d))


@query(f"WITH {STANDARD}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id, pattern_idx) AS k FROM std WHERE mapping_status <> 'mapped' AND extraction_confidence >= 0.85), c AS (SELECT count(*) FILTER (WHERE mapping_status = 'mapped') / count(*) AS share FROM std) SELECT doc_id || '/' || pattern_idx AS item, 'warning' AS severity, 'high_confidence_unmapped_observation' AS code FROM o WHERE k <= 20 UNION ALL SELECT 'membership', 'warning', 'low_membership_coverage' FROM c WHERE share < 0.70")
def coverage_findings(spark, d):
    o = extract.standardize(extracted(spark, d), MAPPING).withColumn("observation_id", F.concat_ws("/", "doc_id", "pattern_idx"))
    return validate.coverage_findings(o, o.where("mapping_status = 'mapped'"), ["doc_id", "pattern_idx"])


@query(f"SELECT o_custkey::VARCHAR AS item, 'error' AS severity, 'duplicate_source_id' AS code FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_custkey::VARCHAR, 'error', 'missing_text' FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_custkey::VARCHAR, 'warning', 'uncertain_metadata' FROM orders WHERE o_orderstatus = 'P'".replace("GROUP BY 1", "GROUP BY o_custkey"))
def source_findings(spark, d):
    src = t(spark, d, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderpriority")).alias("text"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    return validate.source_findings(src, "o_custkey", ["text"], validate.uncertain_metadata(src, "o_custkey", ["status"]))


@query("""WITH s AS (SELECT l_returnflag AS flag, p_brand AS brand, l_partkey AS item, l_suppkey AS expert, greatest(0, least(1, l_tax * 14 - 0.1)) AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 40),
i AS (SELECT flag, brand, item, count(*) AS n, avg(x) AS m FROM s GROUP BY ALL), g AS (SELECT flag, brand, avg(x) AS grand, count(*) AS n, count(DISTINCT expert) AS experts, coalesce(stddev_samp(x), 0) AS sd FROM s GROUP BY ALL),
b AS (SELECT flag, brand, count(*) AS items, sum(i.n * (m - grand) ** 2) AS ssb, sum(i.n * i.n) AS nn FROM i JOIN g USING (flag, brand) GROUP BY ALL), w AS (SELECT flag, brand, sum((x - m) ** 2) AS ssw FROM s JOIN i USING (flag, brand, item) GROUP BY ALL),
v AS (SELECT *, ssb / nullif(items - 1, 0) AS msb, ssw / nullif(g.n - items, 0) AS msw, (g.n - nn / g.n) / nullif(items - 1, 0) AS usual FROM g JOIN b USING (flag, brand) JOIN w USING (flag, brand))
SELECT flag, brand, round(CASE WHEN experts < 2 THEN NULL WHEN items < 2 OR n = items THEN greatest(0, least(1, 1 - sd / 0.5)) WHEN msb + (usual - 1) * msw <= 1e-15 THEN 1 ELSE greatest(0, least(1, (msb - msw) / (msb + (usual - 1) * msw))) END, 6) AS icc, items, n::BIGINT AS n FROM v""")
def agreement(spark, d):
    """Agreement of suppliers' scores of parts, for each brand and flag."""
    p = t(spark, d, "part").where("p_size < 40").select("p_partkey", F.col("p_brand").alias("brand"))
    s = t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    s = s.select(
        F.col("l_returnflag").alias("flag"), "brand", F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("expert_id"),
        (F.col("l_tax") * 14 - 0.1).alias("score")
    )
    return calibrate.agreement(s, ["flag", "brand"], "item")


ROLES = [("E1", "careful"), ("E2", "bold"), ("E3", "even")]
PANEL = f"""panel AS (SELECT expert_id, expert_role, no // 20 AS batch, term, variable FROM (SELECT 'P' || p_partkey AS term, 'v' || p_partkey % 7 AS variable, row_number() OVER (ORDER BY 'P' || p_partkey, 'v' || p_partkey % 7) - 1 AS no FROM part) x, {values(ROLES, "expert_id, expert_role")}),
said AS (SELECT 'E' || (o_orderkey % 4 + 1) AS expert_id, 'P' || o_custkey AS term, 'v' || o_custkey % 8 AS variable, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 200000 END AS score, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE (o_orderkey % 10) / 8.0 END AS confidence, o_orderkey % 11 = 0 AS astray, o_comment_ AS rationale FROM (SELECT *, 'because ' || o_orderkey AS o_comment_ FROM orders))"""


@query(f"""WITH {PANEL}, met AS (SELECT term, variable, expert_id, expert_role, round(greatest(0, least(1, coalesce(score, 0))), 6) AS score, round(greatest(0, least(1, confidence)), 6) AS confidence, rationale, 'panel' AS score_source FROM panel JOIN said USING (expert_id, term, variable) WHERE NOT astray)
SELECT * FROM met UNION ALL SELECT term, variable, expert_id, expert_role, 0, 0, '{calibrate.UNANSWERED}', 'panel_without_answer' FROM panel p WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.expert_id = p.expert_id AND s.term = p.term AND s.variable = p.variable AND NOT astray)""")
def panel_answers(spark, d):
    """Orders as a panel's answers to tasks about parts: some to tasks of other
    batches, some to none, many tasks without one."""
    high = F.lit("high").alias("fuzzy_set")
    tasks = t(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("term"), F.concat(F.lit("v"), F.col("p_partkey") % 7).alias("variable"), high)
    panel = calibrate.panel_tasks(tasks, ROLES)
    key = F.col("o_orderkey")
    said = t(spark, d, "orders").select(
        F.concat(F.lit("E"), key % 4 + 1).alias("expert_id"), F.concat(F.lit("P"), "o_custkey").alias("term"), F.concat(
            F.lit("v"), F.col("o_custkey") % 8
        ).alias("variable"), high,
        F.when(key % 13 == 0, "high").otherwise(
            (F.col("o_totalprice") / 200000).cast("string")
        ).alias("score"), F.when(key % 5 > 0, ((key % 10) / 8.0).cast("string")).alias("confidence"),
        F.concat(F.lit("because "), key).alias("rationale"), (key % 11 == 0).alias("astray"),
    )
    batches = panel.select("term", "batch").distinct()
    n = parts_for(batches)
    said = said.repartition(n, "term").join(batches.repartition(n, "term"), "term", "left").withColumn("batch", F.when(F.col("astray"), F.col("batch") + 1).otherwise(F.col("batch")))
    return calibrate.panel_answers(panel, said).drop("fuzzy_set")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN '' WHEN 5 THEN '' ELSE p_brand || '.' || CASE p_partkey % 6 WHEN 2 THEN 'high' ELSE p_type END || '>=' || (p_size / 64.0::DOUBLE)::VARCHAR || '^1.0' END AS antecedents, p_partkey % 6 = 5 AS unread FROM part""")
def antecedent_cells(spark, d):
    """Cells of antecedents as JSON, in loose braces, as dashes, blank and
    unreadable; the unreadable ones are findings."""
    p, size = t(spark, d, "part"), (F.col("p_size") / 64.0).cast("string")
    kind = F.col("p_partkey") % 6
    text = lambda pattern, *c: F.format_string(pattern, *c)
    cell = (
        F.when(kind == 0, text('[{"variable": "%s", "fuzzy_set": "%s", "threshold": %s}]', "p_brand", "p_type", size))
        .when(kind == 1, text("[{variable: %s, fuzzy_set: '%s', threshold: %s, weight: 1}, {variable: }]", "p_brand", "p_type", size))
        .when(kind == 2, text("- variable: %s\n  threshold: %s\n", "p_brand", size))
        .when(kind == 3, text("- fuzzy_set: \"%s\"\n  variable: '%s'\n  threshold: %s\n- weight: 3", "p_type", "p_brand", size))
        .when(kind == 4, F.lit(" "))
        .otherwise(F.lit("see the other table"))
    )
    rows = p.select(F.col("p_partkey").cast("string").alias("rule_id"), "p_partkey", cell.alias("antecedents"))
    unread = rule_rows.unread_antecedents(rows).select(F.col("item").alias("rule_id"), F.lit(True).alias("unread"))
    shown = F.array_join(
        F.transform(
            rule_rows.parse_antecedents(F.col("antecedents")),
            lambda a: F.concat(a["variable"], F.lit("."), a["fuzzy_set"], F.lit(">="), a["threshold"].cast("string"), F.lit("^"), a["weight"].cast("string"))
        ),
        ","
    )
    return rows.join(unread, "rule_id", "left").select("p_partkey", shown.alias("antecedents"), F.coalesce("unread", F.lit(False)).alias("unread"))


@query("""SELECT event_id, event_type AS value, CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.5 END AS confidence FROM events WHERE event_id % 4 <> 3""")
def answers_two_ways(spark, d):
    """Answers of which the engine reads what is plain JSON, and Python recovers
    the rest; some hold nothing."""
    kind = F.col("event_id") % 4
    row = lambda confidence: F.concat(F.lit('{"feature": "kind", "feature_value": "'), "event_type", F.lit(f'"{confidence}}}'))
    answer = (
        F.when(kind == 0, F.concat(F.lit(' {"observations": ['), row(""), F.lit(', {"feature_value": " "}]}\n')))
        .when(kind == 1, F.concat(F.lit("<THINK>{}</think>```json\n{\"items\": ["), row(', "extraction_confidence": 2'), F.lit(",]}\n```")))
        .when(kind == 2, F.concat(F.lit("["), row(', "extraction_confidence": "0.25"'), F.lit("]")))
        .otherwise(F.lit("nothing found"))
    )
    found = extract.answers_to_rows(t(spark, d, "events").select("event_id", answer.alias("answer")), ["kind"])
    return found.select("event_id", F.col("feature_value").alias("value"), F.col("extraction_confidence").alias("confidence"))


ASSESSED = """parts AS (SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'undated', count(*) FROM documents WHERE lang = 'none'), audit AS (SELECT *, CASE WHEN rows > 0 THEN 'filled' ELSE 'empty' END AS status FROM parts)"""


def assessed(spark, d):
    docs = t(spark, d, "documents")
    return assess.capabilities({"documents": docs, "labels": t(spark, d, "labels"), "undated": docs.where("lang = 'none'")})


@query(f"""WITH n AS (SELECT count(*) AS w FROM ({UNC})), {ASSESSED}, e AS (SELECT count(*) AS k FROM audit WHERE status = 'empty'), bad AS (
  SELECT (SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) = '') + (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS b)
SELECT CASE WHEN b > 0 THEN 'not_ready' WHEN w > 0 OR k > 0 OR g > 0 THEN 'research_ready_with_caveats' ELSE 'formal_ready' END AS verdict, b AS validation_errors, w + CASE WHEN w > 0 THEN 1 ELSE 0 END AS validation_warnings, k AS empty_tables, g AS metrics_needing_gold_standard FROM n, e, bad, (SELECT 1::BIGINT AS g)""")
def completion_assessment(spark, d):
    docs = t(spark, d, "documents")
    found = validate.overall(validate.union(validate.source_findings(docs, "doc_id", ["text"], uncertain(spark, d)), validate.sample_findings(docs)))
    metrics = evaluate.needs_gold(spark, "FCR", "expert_memberships.csv", "")
    columns = ["verdict", "validation_errors", "validation_warnings", "empty_tables", "metrics_needing_gold_standard"]
    return assess.assessment(found, assessed(spark, d), metrics).select(*columns)


@query(f"""WITH {ASSESSED}, needs AS (SELECT * FROM {values([("labels", "documents"), ("undated", "documents"), ("undated", "scores")], "name, input")})
SELECT name, any_value(a.rows) AS rows, string_agg(input, ',' ORDER BY input) AS inputs, coalesce(string_agg(input, ',' ORDER BY input) FILTER (WHERE f.name IS NULL), '') AS lacking,
  CASE WHEN count(*) FILTER (WHERE f.name IS NULL) > 0 THEN 'lacks_input' WHEN any_value(a.rows) > 0 THEN 'met' ELSE 'unfilled' END AS status
FROM needs JOIN audit a USING (name) LEFT JOIN (SELECT name FROM audit WHERE status = 'filled') f ON f.name = input GROUP BY needs.name""".replace("SELECT name, any_value", "SELECT needs.name AS name, any_value"))
def made_from(spark, d):
    """Which inputs each table of a build lacks."""
    found = assess.methods(assessed(spark, d), {"labels": ["documents"], "undated": ["documents", "scores"]})
    return found.withColumns({c: F.array_join(c, ",") for c in ("inputs", "lacking")})
