"""Engine operators against golden values and the SQL of each query."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from attesta.functions import scalars as S
from attesta.operators import chunks, membership, mining, validate
from attesta.plans import queries as plans
from attesta.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = db.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(str([None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float, np.number)) else v for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_overlap_golden():
    own = [0.2, 0.4, 0.8, 1.0]
    assert membership.overlap(own, own, 300) == pytest.approx(0.888896, abs=1e-6)
    assert membership.overlap([0.7, 0.86, 1, 1], [0.6, 0.78, 1, 1]) == pytest.approx(0.986529, abs=1e-6)
    assert membership.overlap([0, 0.1, 0.2, 0.3], [0.5, 0.6, 0.7, 0.8]) == 0


def test_interval_golden(spark):
    config = {"fuzzy_sets": {}, "linguistic_values": {"t": {"maps_to": {"deficiency_property": {"fuzzy_set": "moderate", "prior_membership": 0.62, "icc": 0.68}}}}}
    r = membership.lexicon(spark, config).first()
    assert (r.p5, r.p95) == (0.5628, 0.674862)


def test_itemsets_survive_weak_pairs(spark):
    rows = [(i, x) for i in range(100) for x in ("dummy", *(["a", "b"] if i < 80 else []), *(["c"] if i < 20 else []))]
    b = spark.createDataFrame(rows, "source_id int, item string")
    got = {tuple(r["items"]): r.source_count for r in mining.frequent_itemsets(b, 20).collect()}
    assert got[("a", "b", "c")] == 20 and got[("a", "b")] == 80 and max(map(len, got)) == 4
    assert max(len(r["items"]) for r in mining.frequent_itemsets(b, 20, 3).collect()) == 3


def test_representative_evidence_ranks_first(spark):
    rows = [(p, i, k, f"{p}{k % 2}") for p in "ab" for i in range(40, 0 if p == "a" else 37, -1) for k in range(3)] + [("a", 2, 0, "a0")]
    df = spark.createDataFrame(rows, "pattern string, source_id long, seq int, evidence string").repartition(8)
    got = mining.representative_evidence(df)
    assert {r.pattern: r.evidence for r in got.collect()} == {p: [f"{i}: {p}0；{p}1" for i in ids] for p, ids in (("a", range(1, 6)), ("b", range(38, 41)))}
    limits = re.findall(r"WindowGroupLimit .*?, (dense_rank.*?), (\d+), (Partial|Final)", got._jdf.queryExecution().executedPlan().toString())
    assert {(n, mode) for _, n, mode in limits} == {("5", "Partial"), ("5", "Final")}  # tasks cut their own rows before the shuffle


def test_readiness_counts_errors(spark, tmp_path):
    full = [(i, "the text and more", "en", "s1") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string"
    cases = {
        "formal": (full, (0, 0, "formal_ready")),
        "bad": ([*full, (1, "the text again", "en", "s1"), (50, None, "en", "s1"), (51, "", "de", "s1")], (3, 1, "not_ready")),
        "small": (full[:29], (0, 1, "exploratory_ready")),
        "none": ([], (2, 1, "not_ready")),
    }
    for name, (rows, want) in cases.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert tuple(plans.overall_readiness(spark, f"{tmp_path}/{name}").first()) == want


def test_other_findings(spark):
    codes = lambda df: sorted((r.item, r.severity, r.code) for r in df.collect())
    obs = "observation_id long, mapping_status string, extraction_confidence double"
    o = spark.createDataFrame([(i, "mapped" if i < 60 else "unmapped", 0.9 if i < 95 else 0.8) for i in range(100)], obs)
    got = codes(validate.coverage_findings(o, o.where("observation_id < 69"), ["observation_id"]))
    assert got == sorted([("membership", "warning", "low_membership_coverage"), *[(str(i), "warning", "high_confidence_unmapped_observation") for i in range(60, 80)]])
    assert codes(validate.coverage_findings(o.where("observation_id < 10"), o.where("observation_id < 7"), ["observation_id"])) == []
    assert codes(validate.coverage_findings(o.where("false"), o, ["observation_id"])) == [("all", "error", "no_observations")]
    rules = spark.createDataFrame([("R1", "c", "active_rule", [1]), ("R2", "c", "draft", []), ("R3", "", None, None)], "rule_id string, consequent_entity string, review_status string, antecedents array<int>")
    assert codes(validate.rule_errors(rules)) == [("R2", "error", "rule_without_antecedents"), ("R3", "error", "rule_without_antecedents"), ("R3", "error", "rule_without_consequent")]
    assert codes(validate.rule_errors(rules.where("false"))) == [("all", "error", "no_rules")]
    assert codes(validate.inactive_rules(rules)) == [("R2", "warning", "inactive_rule_status"), ("R3", "warning", "inactive_rule_status")]
    gold = spark.createDataFrame([("FCR", "needs_gold_standard"), ("CRP", "ok")], "metric string, status string")
    assert codes(validate.gold_findings(gold)) == [("FCR", "warning", "missing_gold_standard")]


def test_json_recovery():
    assert S.recover_payload('<think>x</think>```json\n{"items": [{"a": 1},]}\n```') == '[{"a": 1}]'
    assert S.recover_payload('[{"a": 2}]') == '[{"a": 2}]'
    assert S.recover_payload('so: {"observations": [1]} done') == "[1]"
    assert S.recover_payload("nothing") is None


def test_cut_points_advance():
    text = "x" * 500 + "\n" + "y" * 4000 + ". " + "z" * 3000
    spans = list(chunks.cut_points(text, 1800, 80))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b and b - a <= 1800 for a, b in spans) and all(p[0] < q[0] <= p[1] for p, q in zip(spans, spans[1:]))


def test_chapters_of_other_names(spark):
    raw = spark.createDataFrame([("书", "1.0", "long body text", None), ("书", "2", "b", "0.5")], ["书名", "序号", "其他", "text_integrity"])
    r = tables.chapters(raw).orderBy("source_seq").collect()
    assert [x.chapter_order for x in r] == [1, 2] and r[0].text_original == "long body text" and r[0].text_integrity == 1.0 and r[0].source_authority == 0.5
    kept, report = tables.normalize(raw.drop("text_integrity"), "book")  # whose name would match "text" in part
    assert report["rows_out"] == 2 and kept.first().source_authority == 0.8


def test_texts_are_cut_a_few_at_once(spark):
    from attesta.operators import chunks

    texts = ["a. " * 900, " ", None, "line\n" * 800, "漢。" * 2000, "short"]
    got = chunks.plan_chunks(spark.createDataFrame(list(enumerate(texts)), "source_id int, text string"), size=1800, overlap=80)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    by = {}
    for r in sorted(got.collect()):
        by.setdefault(r.source_id, []).append(r.chunk)
    plain = {i: [t.strip()[a:b].strip() for a, b in chunks.cut_points(t.strip(), 1800, 80)] for i, t in enumerate(texts) if t and t.strip()}
    assert by == plain


def test_the_network_infers_once(spark, monkeypatch):
    from attesta.plans import queries as q

    calls, fired_rows = [], q.fired_rows
    monkeypatch.setattr(q, "fired_rows", lambda *a: calls.append(a) or fired_rows(*a))
    q.relations(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
