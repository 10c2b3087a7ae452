"""Expert calibration of the lexicon and the deterministic panel."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import clamp01, rounded
from ..sources.shared import parts_for
from .extract import number

#: What makes a task of a panel.
TASK = ["term", "variable", "fuzzy_set"]
ANSWER = "term string, variable string, fuzzy_set string, score string, confidence string, rationale string"
UNANSWERED = "no answer; counted as a score without confidence"
#: Shift of each role's score from the prior (fixed values of the panel).
ROLE_SHIFTS = {"conservative": -0.03, "liberal": 0.03, "neutral": 0.0}


#: Columns that a table of expert scores must have (fixed names).
REQUIRED = ("term", "variable", "fuzzy_set", "expert_id", "score")


def checked_scores(scores: DataFrame) -> DataFrame:
    """``scores``, if it has the columns that calibration needs."""
    missing = sorted(set(REQUIRED) - set(scores.columns))
    if missing:
        raise ValueError(f"expert scores lack the columns {missing}")
    return scores


def calibration(scores: DataFrame, keys: list[str], score: str = "score", expert: str = "expert_id") -> DataFrame:
    """Median, mean, 5th and 95th percentile (linear), experts, scores and the
    agreement proxy 1 - sd / 0.5 of each key, null below two experts. Scores
    are clamped to [0, 1] first (not a number: 0); null keys are keys. A task
    holds the different scores of a key, not its rows."""
    s = scores.withColumn("__s", clamp01(F.col(score)))
    g = s.groupBy(*keys).agg(
        F.median("__s").alias("median"), F.avg("__s").alias("mean"), F.percentile("__s", F.lit(0.05)).alias("p5"),
        F.percentile("__s", F.lit(0.95)).alias("p95"), F.countDistinct(expert).alias("experts"), F.count("*").alias("n"),
        F.coalesce(F.stddev_samp("__s"), F.lit(0.0)).alias("sd")
    )
    icc = F.when(F.col("experts") >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / 0.5)))
    g = g.withColumn("icc", icc)
    return g.select(
        *keys, *[F.round(c, 6).alias(c) for c in ("median", "mean", "p5", "p95", "icc")], "experts", "n",
        F.when(F.col("icc") < 0.75, "low_agreement").otherwise("calibrated").alias("review_status")
    )


def merge_calibration(tasks: DataFrame, report: DataFrame, source: str = "expert") -> DataFrame:
    """The lexicon of ``scoring_tasks`` with each calibrated mapping's prior,
    statistics, status and review replaced; terms that only the report has are
    added. A mapping is a term and a variable: of several fuzzy sets the last
    by name counts. ``source``: ``expert`` or ``panel``."""
    last = report.groupBy("term", "variable").agg(F.max(F.struct("fuzzy_set", "median", "mean", "p5", "p95", "icc", "experts", "n")).alias("r"))
    d = tasks.join(last, ["term", "variable"], "full")
    done = F.col("r").isNotNull()
    status = F.when(F.coalesce(F.col("r.icc") >= 0.75, F.lit(True)), "expert_calibrated").otherwise("expert_calibrated_low_icc")
    reviewed = {"expert": "expert_reviewed", "panel": "llm_roleplay_reviewed"}[source]
    return d.select(
        "term", "variable", F.coalesce(
            "feature", F.lit("expert_calibrated")
        ).alias("feature"), F.coalesce("r.fuzzy_set", "fuzzy_set").alias("fuzzy_set"), F.coalesce("r.median", "prior_membership").alias("prior_membership"),
        F.col("r.median").alias(
            "calibrated_membership"
        ), F.col("r.mean").alias("expert_mean"), F.col("r.p5").alias("expert_p5"), F.col("r.p95").alias("expert_p95"), F.col("r.icc").alias("icc"),
        F.when(done, status).otherwise(
            F.col("current_status")
        ).alias("status"), F.when(done, reviewed).otherwise(F.col("review_status")).alias("review_status"),
        F.when(
            done & F.lit(source == "panel"), "llm_roleplay_panel"
        ).alias("calibration_source"), F.col("r.experts").alias("expert_count"), F.col("r.n").alias("score_count"),
    )


def calibrated_config(config: dict[str, Any], merged: DataFrame) -> dict[str, Any]:
    """``config`` with the linguistic values of ``merge_calibration``. The
    lexicon is configuration, so its rows come to the driver."""
    out = copy.deepcopy(config)
    terms = out.setdefault("linguistic_values", {})
    names = (
        "fuzzy_set", "prior_membership", "calibrated_membership", "expert_mean", "expert_p5", "expert_p95", "status", "icc",
        "review_status", "calibration_source", "expert_count", "score_count"
    )
    for r in merged.where("calibrated_membership IS NOT NULL").collect():
        entry = terms.setdefault(r["term"], {"feature": "expert_calibrated", "maps_to": {}})
        entry.setdefault("maps_to", {}).setdefault(r["variable"], {}).update({n: r[n] for n in names if n != "calibration_source" or r[n]})
    return out


def scoring_tasks(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """One row per term and variable of the configuration, to be scored."""
    rows = []
    for term, entry in config.get("linguistic_values", {}).items():
        for variable, m in (entry.get("maps_to", {}) if isinstance(entry, dict) else {}).items():
            if isinstance(m, dict):
                prior = m.get("calibrated_membership", m.get("prior_membership", 0.5))
                rows.append(
                    (
                        str(term), str(entry.get("feature", "")), str(variable), str(m.get("fuzzy_set", "high")),
                        float(min(1.0, max(0.0, 0.5 if prior is None else prior))),
                        str(m.get("status", entry.get("status", "bootstrap_prior"))),
                        str(m.get("review_status", entry.get("review_status", "pending")))
                    )
                )
    return spark.createDataFrame(
        rows,
        "term string, feature string, variable string, fuzzy_set string, prior_membership double, current_status string, review_status string"
    )


def agreement(scores: DataFrame, keys: list[str], item: str, score: str = "score", expert: str = "expert_id") -> DataFrame:
    """(keys, icc, items, n): the one-way coefficient of agreement of each key,
    whose ``item`` says what was scored: the share of variance that lies
    between items rather than within them, for any number of scores an item.

    Two aggregates: sums and squares of an item, then of a key, so neither a
    key's nor an item's rows ever meet. Scores are clamped to [0, 1] (not a
    number: 0). Below two experts the coefficient is null; with fewer than two
    items or no item scored twice it is the proxy of ``calibration``; without
    any variance 1; negative ones are 0."""
    s = scores.select(*keys, F.col(item).alias("__item"), F.col(expert).alias("__e"), clamp01(F.col(score)).alias("__s"))
    sums = [F.count("*").alias("n"), F.sum("__s").alias("t"), F.sum(F.col("__s") * F.col("__s")).alias("q")]
    each = s.groupBy(*keys, "__item").agg(*sums)
    of = F.sum(F.col("t") * F.col("t") / F.col("n"))
    g = each.groupBy(*keys).agg(
        F.count("*").alias("items"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("t").alias("t"),
        F.sum("q").alias("q"), of.alias("of")
    )
    experts = s.groupBy(*keys).agg(F.countDistinct("__e").alias("experts"), F.coalesce(F.stddev_samp("__s"), F.lit(0.0)).alias("sd"))
    same = [g[k].eqNullSafe(experts[k]) for k in keys]
    d = g.join(experts, same).select(*[g[k] for k in keys], "items", "n", "nn", "t", "q", "of", "experts", "sd")
    n, items = F.col("n"), F.col("items")
    between = (F.col("of") - F.col("t") * F.col("t") / n) / (items - 1)
    within = F.greatest(F.lit(0.0), F.col("q") - F.col("of")) / (n - items)
    d = d.withColumns({"between": between, "within": within, "usual": (n - F.col("nn") / n) / (items - 1)})
    total = F.col("between") + (F.col("usual") - 1) * F.col("within")
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    true = F.when(total <= 1e-15, F.lit(1.0)).otherwise(cut((F.col("between") - F.col("within")) / total))
    proxy = cut(1 - F.col("sd") / 0.5)
    icc = F.when(F.col("experts") >= 2, F.when((items >= 2) & (n > items), true).otherwise(proxy))
    return d.select(*keys, F.round(icc, 6).alias("icc"), "items", "n")


def panel_tasks(tasks: DataFrame, roles: list[tuple[str, str]], batch: int = 20) -> DataFrame:
    """(expert_id, expert_role, batch, ``TASK``): each different task for each
    role (few: configuration), in batches of ``batch`` by the order of tasks.
    Tasks are numbered range by range, so no task of Spark's sees them all."""
    numbered = number(tasks.select(*TASK).distinct(), TASK, "no")
    role = F.explode(F.array(*[F.struct(F.lit(e).alias("expert_id"), F.lit(r).alias("expert_role")) for e, r in roles]))
    d = numbered.select(*TASK, F.floor((F.col("no") - 1) / batch).alias("batch"), role.alias("r"))
    return d.select("r.expert_id", "r.expert_role", "batch", *TASK)


def ask(panel: DataFrame, scorer: Callable[[str, list[dict]], list[dict]]) -> DataFrame:
    """Raw answers (expert_id, batch, ``ANSWER``) of ``scorer(role, tasks)``,
    called once a batch in the executors; what isn't a row of names goes."""
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        rows = t.select(TASK).to_pylist()
        found = [a for a in scorer(t.column("expert_role")[0].as_py(), rows) or [] if isinstance(a, dict)]
        text = lambda v: None if v is None else str(v)
        cells = {n: pa.array([text(a.get(n)) for a in found], pa.string()) for n in names}
        same = {c: pa.array([t.column(c)[0].as_py()] * len(found), kind) for c, kind in (("expert_id", pa.string()), ("batch", pa.int64()))}
        return pa.table({**same, **cells})

    return panel.groupBy("expert_id", "batch").applyInArrow(run, f"expert_id string, batch long, {ANSWER}")


def panel_answers(panel: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores of a panel: answers to tasks of their own batch, clamped (not a
    number: score 0, confidence 0.5), with 500 characters of reason; answers to
    anything else go; tasks without any get score 0 and confidence 0.
    ``answers``: as ``ask`` gives them, or a table of them; they are read once.
    Tasks of the panel and their answers meet in as many parts as the panel's
    rows ask for."""
    key = ["expert_id", "batch", *TASK]
    said = answers.select(*key, "score", "confidence", F.substring(F.coalesce("rationale", F.lit("")), 1, 500).alias("rationale"), F.lit(True).alias("met"))
    n = parts_for(panel)
    both = panel.repartition(n, *key).join(said.repartition(n, *key), key, "left")
    confidence = F.when(F.col("confidence").isNull(), 0.5).otherwise(clamp01(F.col("confidence"), 0.5))
    given = lambda c, otherwise: F.when(F.col("met"), c).otherwise(otherwise)
    return both.select(
        *TASK, "expert_id", "expert_role", given(rounded(clamp01(F.col("score"))), 0.0).alias("score"), given(rounded(confidence), 0.0).alias("confidence"),
        given(F.col("rationale"), UNANSWERED).alias("rationale"), given(F.lit("panel"), "panel_without_answer").alias("score_source"),
    )


def panel_calibration(tasks: DataFrame) -> DataFrame:
    """The lexicon calibrated by the deterministic panel's scores."""
    scores = panel(tasks.select("term", "variable", "fuzzy_set", "prior_membership"), "prior_membership")
    return merge_calibration(tasks, calibration(checked_scores(scores), ["term", "variable", "fuzzy_set"]), "panel")


def calibration_template(memberships: DataFrame, observations: DataFrame, order: list[str]) -> DataFrame:
    """A row per membership for experts to fill in, with its observation."""
    o = observations.select(
        "observation_id", F.col("feature").alias("o_feature"), F.col("feature_value").alias("o_value"),
        F.col("evidence_text").alias("o_text")
    )
    d = number(memberships, order, "calibration_id", "CAL").join(o, "observation_id", "left")
    blank = [F.lit("").alias(c) for c in ("expert_accept_observation", "expert_accept_mapping", "expert_membership", "expert_comment")]
    text = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    return d.select(
        "calibration_id", "source_id", "observation_id", text("o_feature", "feature"), text("o_value", "feature_value"),
        "standard_observation", text("o_text", "evidence_text"), "variable", "fuzzy_set", F.col("membership").alias("model_membership"),
        "p5", "p95", "uncertainty_width", "calculation_mode", "status", "icc", *blank
    )


def panel(lexicon: DataFrame, prior: str = "membership") -> DataFrame:
    """Scores of three roles for each row of the lexicon."""
    roles = F.array(*[F.struct(F.lit(k).alias("expert_id"), F.lit(v).alias("shift")) for k, v in ROLE_SHIFTS.items()])
    e = lexicon.withColumn("role", F.explode(roles))
    return e.select(
        *lexicon.columns, F.col("role.expert_id").alias("expert_id"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prior) + F.col("role.shift"))), 6).alias("score")
    )
