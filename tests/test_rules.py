"""Inference over rule tables against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import infer

BEST = "source_id long, variable_key string, membership double, p5 double, p95 double"
RULES = "rule_id string, consequent_entity string, consequent_type string, rule_weight double, review_status string, antecedents array<struct<variable:string,fuzzy_set:string,threshold:double,weight:double>>"


def plain(best, rules):
    by = {}
    for s, k, m, lo, hi in best:
        by.setdefault(s, {})[k] = (m, lo, hi)
    out = []
    for s, values in by.items():
        for r, c, kind, w, status, ants in rules:
            if status not in infer.ACTIVE:
                continue
            total, low, high, missing, held, ranged = w, w, w, [], [], False
            for v, f, threshold, weight in ants:
                m, lo, hi = values.get(f"{v}.{f}", (0.0, None, None))
                (missing if m < (threshold or 0.0) else held).append(f"{v}.{f}")
                total *= math.pow(max(m, 1e-12), weight)
                low *= math.pow(max(m if lo is None else lo, 1e-12), weight)
                high *= math.pow(max(m if hi is None else hi, 1e-12), weight)
                ranged |= lo is not None or hi is not None
            cut = lambda x: round(max(0.0, min(1.0, x)), 6)
            out.append((s, r, c, kind, cut(total), held, missing, "below_threshold" if missing else "fired", cut(low) if ranged else None, cut(high) if ranged else None))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(12)] + ["a.b", "", "漢"]
    grid = lambda: rng.randrange(1, 16) / 16
    # v0 is in every source, v11 in none
    best = [(s, f"{v}.h", grid(), grid() if rng.random() < 0.3 else None, grid() if rng.random() < 0.3 else None) for s in range(60) for v in names if v != "v11" and (v == "v0" or rng.random() < 0.3)]
    rules = []
    for i in range(150):
        ants = [(rng.choice(names), "h", rng.choice([0.0, 0.0, -1.0, None, grid()]), rng.choice([0.5, 1.0, 2.0])) for _ in range(rng.randrange(0, 4))]
        rules.append((f"R{i % 140}", f"c{i % 3}", "k", grid(), rng.choice([*infer.ACTIVE, "draft"]), ants))
    return best, rules


@pytest.mark.parametrize("limit", [1 << 25, 4000])
def test_index_and_every_rule(spark, monkeypatch, limit):
    monkeypatch.setattr(infer, "RULE_BYTES", limit)
    best, rules = made(limit)
    b, r = spark.createDataFrame(best, BEST), spark.createDataFrame(rules, RULES)
    assert (infer.slim_rules(r)[1] > 1) == (limit == 4000)
    want = plain(best, rules)
    close = lambda a, b: [x[:4] + x[5:8] for x in a] == [x[:4] + x[5:8] for x in b] and all(abs((x or 0) - (y or 0)) < 2e-6 and (x is None) == (y is None) for u, v in zip(a, b) for x, y in zip((u[4], *u[8:]), (v[4], *v[8:])))
    key = lambda x: (x[0], x[1], str(x[5:8]), round(x[4], 5))
    got = sorted((tuple(x) for x in infer.larsen(b, r).collect()), key=key)
    assert close(got, sorted(want, key=key))
    fired = sorted((tuple(x) for x in infer.fired(b, r).collect()), key=key)
    assert close(fired, sorted((x for x in want if x[7] == "fired"), key=key)) and len(fired) > 100


@pytest.mark.parametrize("steps", [0, 2, 8])
def test_rules_longer_than_the_steps_written_out(spark, monkeypatch, steps):
    monkeypatch.setattr(infer, "STEPS", steps)
    best, rules = made(5)
    rules += [(f"L{n}", "c", "k", 0.75, "active_rule", [(f"v{i % 4}", "h", 0.0625 if i == 0 else None, 0.5) for i in range(n)]) for n in (8, 9, 12)]
    b, r = spark.createDataFrame(best, BEST), spark.createDataFrame(rules, RULES)
    key = lambda x: (x[0], x[1], str(x[5:8]), round(x[4], 5))
    want = sorted(plain(best, rules), key=key)
    for f, rows in ((infer.larsen, want), (infer.fired, [x for x in want if x[7] == "fired"])):
        got = sorted((tuple(x) for x in f(b, r).collect()), key=key)
        assert [x[:4] + x[5:8] for x in got] == [x[:4] + x[5:8] for x in rows] and {"L8", "L9", "L12"} <= {x[1] for x in got}
        for g, w in zip(got, rows):
            assert all((x is None) == (y is None) and abs((x or 0) - (y or 0)) < 2e-6 for x, y in zip((g[4], *g[8:]), (w[4], *w[8:])))


def test_steps_of_short_rules_are_compiled(spark):
    best, rules = made(6)
    b, r = spark.createDataFrame(best, BEST), spark.createDataFrame(rules, RULES)
    for f in (infer.larsen, infer.fired):
        assert "lambda" not in f(b, r).drop("status")._jdf.queryExecution().executedPlan().toString()


def test_no_rules_no_memberships(spark):
    best, rules = made(3)
    b, r = spark.createDataFrame(best, BEST), spark.createDataFrame(rules, RULES)
    for f in (infer.larsen, infer.fired):
        assert f(b.where("false"), r).count() == 0 == f(b, r.where("false")).count()
    alone = spark.createDataFrame([(1, None, 0.5, None, None)], BEST)
    assert infer.larsen(alone, r).count() == sum(x[4] != "draft" for x in rules)


def test_no_cross_join(spark):
    best, rules = made(4)
    b, r = spark.createDataFrame(best, BEST), spark.createDataFrame(rules, RULES)
    for f in (infer.larsen, infer.fired):
        plan = f(b, r)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_a_rare_variable_files_the_rule(spark):
    best = [(s, "common.h", 0.9, None, None) for s in range(100)] + [(7, "rare.h", 0.9, None, None)]
    rules = [(f"R{i}", "c", "k", 1.0, "active_rule", [("common", "h", 0.5, 1.0), ("rare", "h", 0.5, 1.0)]) for i in range(50)]
    got = infer.fired(spark.createDataFrame(best, BEST), spark.createDataFrame(rules, RULES))
    assert {(r.source_id, r.activation) for r in got.collect()} == {(7, 0.81)} and got.count() == 50
    assert got.agg(F.countDistinct("rule_id").alias("n")).first()["n"] == 50


def test_centroids_by_plain_loops_without_an_expression_a_point(spark):
    shapes = {"R1": (0.45, 0.70, 1.0, 1.0), "R2": (0.2, 0.4, 0.6, 0.8), "R3": (0.3, 0.3, 0.3, 0.9)}
    rows = [(i, "c", k, (i * 7 + j * 3) % 11 / 10) for i in range(40) for j, k in enumerate(shapes) if (i + j) % 3]
    fired = spark.createDataFrame(rows, "source_id long, consequent_entity string, rule_id string, activation double")
    got = infer.mamdani(fired, spark.createDataFrame([(k, *v) for k, v in shapes.items()], "rule_id string, a double, b double, c double, d double"), 50)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()

    def height(x, a, b, c, d):
        return 0.0 if x < a or x > d else 1.0 if b <= x <= c else (x - a) / (b - a) if x < b else (d - x) / (d - c)

    for r in got.collect():
        cuts = sorted((k, m) for i, _, k, m in rows if i == r.source_id)
        xs = [i / 49 for i in range(50)]
        ys = [max(min(m, height(x, *shapes[k])) for k, m in cuts) for x in xs]
        area = sum((ys[i] + ys[i + 1]) / 2 * (xs[i + 1] - xs[i]) for i in range(49))
        moment = sum((xs[i] * ys[i] + xs[i + 1] * ys[i + 1]) / 2 * (xs[i + 1] - xs[i]) for i in range(49))
        assert r.rules == [k for k, _ in cuts]
        assert (r.centroid, r.area, r.max_membership) == pytest.approx((moment / area if area > 0 else 0.0, area, max(ys)), abs=1e-6)
