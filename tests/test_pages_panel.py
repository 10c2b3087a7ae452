"""Page files, the panel, and two-way parsing, by round trips and plain versions."""

import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import calibrate, extract, rules
from attesta.sources import pages, shared

PAGES = [("index.md", "# All\n"), ("sources/SRC 1+2%.md", "body\r\nwith lines\n"), ("syndromes/肾虚证.md", "漢字"), ("empty.md", ""), ("none.md", None), ("a/b/c/deep.md", "x" * 100_000)]


def test_pages_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "path string, body string").repartition(4)
    folder = f"{tmp_path}/out"
    for _ in range(2):  # a second run writes the same pages over
        pages.write_pages(df, folder)
        got = {r.path: r.body for r in pages.read_pages(spark, folder).collect() if not r.path.startswith("_")}
        want = {p: b or "" for p, b in PAGES if b} | {p: got.get(p) or "" for p, b in PAGES if not b}
        assert {p: b for p, b in got.items() if b} == {p: b for p, b in want.items() if b}
    for p, b in PAGES:
        with open(f"{folder}/{p}", newline="") as f:
            assert f.read() == (b or "")
    with open(f"{folder}/{pages.DONE}") as f:
        assert f.read().startswith("6 pages, ")
    assert not [f for _, _, names in os.walk(folder) for f in names if f.startswith(".") and not f.endswith(".crc")]


def test_bad_paths_write_nothing(spark, tmp_path):
    for rows, code in (([("a.md", "x"), ("A.md", "y")], "clashing_path"), ([("../a.md", "x")], "unfit_path"), ([(None, "x")], "unfit_path"), ([("/a.md", "x")], "unfit_path"), ([("a", "x"), ("a/b.md", "y")], "path_is_a_folder")):
        df = spark.createDataFrame(rows, "path string, body string")
        assert code in {r.code for r in pages.bad_paths(df).collect()}
        with pytest.raises(ValueError, match="can't be written"):
            pages.write_pages(df, f"{tmp_path}/none")
    assert not os.path.exists(f"{tmp_path}/none")
    pages.write_pages(spark.createDataFrame([], "path string, body string"), f"{tmp_path}/some")
    assert os.listdir(f"{tmp_path}/some") == [pages.DONE]


def test_a_task_that_dies_leaves_whole_pages(spark, tmp_path):
    def fail(path):
        if path == "p7.md":
            raise RuntimeError("lost")
        return path * 1000

    body = F.udf(fail, "string")
    df = spark.range(8).select(F.format_string("p%d.md", "id").alias("path")).repartition(2).withColumn("body", body("path"))
    with pytest.raises(Exception, match="lost"):
        df.write.format("noop").mode("overwrite").save()
        pages.write_pages(df, f"{tmp_path}/out")
    spark.dataSource.register(pages.Pages)
    with pytest.raises(Exception, match="lost"):
        df.write.format("pages").mode("append").save(f"{tmp_path}/out")
    left = [f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")] if os.path.exists(f"{tmp_path}/out") else []
    assert pages.DONE not in left and all(open(f"{tmp_path}/out/{f}").read() == f * 1000 for f in left)


def test_panel(spark):
    tasks = spark.createDataFrame([(f"t{i:02d}", "v", "high") for i in range(45)] + [("t00", "v", "high")], "term string, variable string, fuzzy_set string")
    panel = calibrate.panel_tasks(tasks, [("E1", "careful"), ("E2", "bold")], 20)
    sizes = sorted(r["count"] for r in panel.groupBy("expert_id", "batch").count().collect())
    assert sizes == [5, 5, 20, 20, 20, 20]

    def scorer(role, rows):
        assert len(rows) <= 20
        found = [{"term": r["term"], "variable": r["variable"], "fuzzy_set": r["fuzzy_set"], "score": 2 if role == "bold" else "0.25", "rationale": "r" * 900} for r in rows if r["term"] != "t03"]
        return [*found, "noise", {"term": "foreign", "variable": "v", "fuzzy_set": "high", "score": 1}, {"term": "t44", "variable": "v", "fuzzy_set": "high", "score": 1}]

    got = calibrate.panel_answers(panel, calibrate.ask(panel, scorer)).collect()
    by = {}
    for r in got:
        by.setdefault((r.expert_id, r.term), []).append((r.score, r.confidence, len(r.rationale), r.score_source))
    assert len(by) == 90 and ("E1", "foreign") not in by
    assert by["E1", "t01"] == [(0.25, 0.5, 500, "panel")] and by["E2", "t01"] == [(1.0, 0.5, 500, "panel")]
    assert by["E1", "t03"] == [(0.0, 0.0, len(calibrate.UNANSWERED), "panel_without_answer")]
    assert len(by["E1", "t44"]) == 2  # answered twice in its own batch, and not by others


def test_scores_a_bit_under_a_half_are_rounded_up(spark):
    panel = calibrate.panel_tasks(spark.createDataFrame([("t", "v", "high")], "term string, variable string, fuzzy_set string"), [("E1", "careful")])
    answers = panel.select("expert_id", "batch", *calibrate.TASK, (F.lit(137058.3) / 200000).cast("string").alias("score"), F.lit("0.1234565").alias("confidence"), F.lit("r").alias("rationale"))
    got = calibrate.panel_answers(panel, answers).first()
    assert (got.score, got.confidence) == (0.685292, 0.123457)


def test_a_panel_reads_its_answers_once_and_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 4)
    tasks = spark.createDataFrame([(f"t{i:02d}", "v", "high") for i in range(45)], "term string, variable string, fuzzy_set string")
    panel = calibrate.panel_tasks(tasks, [("E1", "careful"), ("E2", "bold")], 20)
    calls = spark.sparkContext.accumulator(0)

    def scorer(role, rows):
        calls.add(1)
        return [{"term": r["term"], "variable": r["variable"], "fuzzy_set": r["fuzzy_set"], "score": 1} for r in rows[1:]]

    got = calibrate.panel_answers(panel, calibrate.ask(panel, scorer))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert shared.parts_for(panel) == 23 and plan.count(", 23), REPARTITION_BY_NUM") == 2
    assert sorted(r.score_source for r in got.collect()) == ["panel"] * 84 + ["panel_without_answer"] * 6
    assert calls.value == 6


def test_only_broken_answers_go_through_python(spark):
    rows = [(1, '{"observations": [{"feature_value": "a"}]}'), (2, "<think>x</think>{\"items\": [{\"feature_value\": \"b\"}]}"), (3, None), (4, '{"observations": "none"}'), (5, "[{\"feature_value\": \"c\"}]"), (6, '{"observations": [{"feature_value": "d"}]} and {more}')]
    df = spark.createDataFrame(rows, "id int, answer string")
    found = extract.answers_to_rows(df, ["symptom"])
    assert {(r.id, r.feature_value) for r in found.collect()} == {(1, "a"), (2, "b"), (5, "c"), (6, "d")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan


def test_rules_that_can_not_be_read_are_findings(spark):
    cells = ['[{"variable": "a"}]', "{variable: b, threshold: 0.5}", "- variable: c\n  weight: 2\n- variable: d", "[]", "", None, "nan", "a and b", "[{fuzzy_set: high}]"]
    df = spark.createDataFrame([(f"R{i}", c, "x") for i, c in enumerate(cells)], "rule_id string, antecedents string, consequent_entity string")
    assert {r.item for r in rules.unread_antecedents(df).collect()} == {"R7", "R8"}
    got = {r.rule_id: [(a.variable, a.fuzzy_set, a.threshold, a.weight) for a in r.antecedents] for r in rules.build_rules(df).collect()}
    assert got == {"R0": [("a", "high", 0.0, 1.0)], "R1": [("b", "high", 0.5, 1.0)], "R2": [("c", "high", 0.0, 2.0), ("d", "high", 0.0, 1.0)]}
