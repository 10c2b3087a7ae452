"""Fuzzy memberships by a lexicon, which is small and broadcast."""

from __future__ import annotations

import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import trapezoid
from ..sources.shared import small

LEXICON = "term string, variable string, fuzzy_set string, membership double, calculation_mode string, status string, icc double, p5 double, p95 double, uncertainty_width double, maps_idx int"


def shape(points: list[float], x: np.ndarray) -> np.ndarray:
    a, b, c, d = points
    up = np.ones_like(x) if b == a else np.clip((x - a) / (b - a), 0, 1)
    down = np.ones_like(x) if d == c else np.clip((d - x) / (d - c), 0, 1)
    return np.where((x < a) | (x > d), 0.0, np.minimum(up, down))


def overlap(left: list[float], right: list[float], points: int = 200) -> float:
    """Share of the left shape's area under the product of both."""
    x = np.linspace(min(left[0], right[0]), max(left[3], right[3]), points)
    y = shape(left, x)
    area = np.trapezoid(y, x)
    return float(np.trapezoid(y * shape(right, x), x) / area) if area > 0 else 0.0


def fuzzy_sets(config: dict[str, Any]) -> list[tuple[str, str, list[float]]]:
    """(variable, fuzzy_set, points) of a configuration."""
    points = lambda spec: [float(p) for p in (spec["points"] if isinstance(spec, dict) else spec)]
    return [(v, name, points(spec)) for v, sets in config.get("fuzzy_sets", {}).items() for name, spec in sets.items()]


def lexicon(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """One row per term and variable with its membership and, where experts
    agreed little, its 5th to 95th percentile. Memberships depend on the
    mapping alone, never on the observation, so they are computed here once."""
    spread, sets = config.get("uncertainty_propagation", {}), config.get("fuzzy_sets", {})
    points = int(config.get("membership_calculation", {}).get("numerical_integration", {}).get("points", 200))
    rows = []
    for term, entry in config.get("linguistic_values", {}).items():
        for i, (variable, m) in enumerate((entry or {}).get("maps_to", {}).items()):
            name, icc = str(m.get("fuzzy_set", "high")), m.get("icc")
            own, goal = m.get("linguistic_set"), sets.get(variable, {}).get(name)
            mu, mode = (
                overlap(own["points"], goal["points"], points), "overlap_integral"
            ) if own and goal else (float(m.get("prior_membership", 0.5)), "prior_membership")
            mu = min(1.0, max(0.0, mu))
            p5 = p95 = None
            if icc is not None and icc < spread.get("icc_threshold", 0.75):
                seed = zlib.crc32(f"{spread.get('random_seed', 20260531)}|{variable}|{name}|{round(mu, 6)}|{round(float(icc), 6)}".encode())
                drawn = np.clip(np.random.default_rng(seed).normal(mu, max(0.03, (1 - icc) * 0.12), int(spread.get("n_samples", 200))), 0, 1)
                p5, p95 = (float(p) for p in np.percentile(drawn, [5, 95]))
            width = None if p5 is None else round(p95 - p5, 6)
            rows.append(
                (
                    term, variable, name, round(mu, 6), mode, str(m.get("status", entry.get("status", "bootstrap_prior"))),
                    None if icc is None else float(icc), None if p5 is None else round(p5, 6), None if p95 is None else round(p95, 6),
                    width, i
                )
            )
    return spark.createDataFrame(rows, LEXICON)


def memberships(observations: DataFrame, lex: DataFrame) -> DataFrame:
    """Observations joined with the lexicon by feature value; only where that
    has no entry, by standard observation. One row per variable of the entry.
    The lexicon is as large as the configuration; it is broadcast if it is
    small indeed."""
    lex = small(lex)
    terms = small(lex.select(F.col("term").alias("__term")).distinct())
    keyed = observations.join(terms, F.col("feature_value") == F.col("__term"), "left")
    keyed = keyed.withColumn("__key", F.coalesce("__term", "standard_observation")).drop("__term")
    return keyed.join(lex, F.col("__key") == F.col("term")).drop("__key", "term")


def coverage(observations: DataFrame, with_membership: DataFrame, key: str = "observation_id") -> DataFrame:
    """Share of observations with at least one membership; 1 without any."""
    have = with_membership.select(F.col(key).alias("__k")).distinct()
    both = observations.join(have, F.col(key) == F.col("__k"), "left")
    return both.agg(F.count("__k").alias("mapped"), F.count("*").alias("observations")).withColumn(
        "coverage", F.when(F.col("observations") == 0, 1.0).otherwise(F.round(F.col("mapped") / F.col("observations"), 6))
    )


def overlap_table(pairs: DataFrame, points: int = 200) -> DataFrame:
    """``overlap`` for a table of pairs with l0..l3 and r0..r3 and a key, as a
    grid of points, for pairs too many for the driver."""
    lo, hi = F.least("l0", "r0"), F.greatest("l3", "r3")
    grid = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", lo + (hi - lo) * F.col("i") / (points - 1))
    y = trapezoid(F.col("x"), *[F.col(f"l{k}") for k in range(4)])
    grid = grid.withColumn("y", y).withColumn("z", F.col("y") * trapezoid(F.col("x"), *[F.col(f"r{k}") for k in range(4)]))
    w = Window.partitionBy("key").orderBy("i")
    step = (F.lead("x").over(w) - F.col("x")) / 2
    areas = grid.withColumns({"ay": (F.col("y") + F.lead("y").over(w)) * step, "az": (F.col("z") + F.lead("z").over(w)) * step})
    return areas.groupBy("key").agg(F.round(F.coalesce(F.sum("az") / F.nullif(F.sum("ay"), F.lit(0.0)), F.lit(0.0)), 6).alias("overlap"))
