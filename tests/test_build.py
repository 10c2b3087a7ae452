"""The assembled build against the golden numbers of the demonstration, and the
parts that no table of the driver reaches."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import aggregate, assess, calibrate, chunks, evaluate, extract, infer, mining, patterns, report, rules, validate
from attesta.plans.build import build
from attesta.sources import files, tables

from . import demo


@pytest.fixture(scope="module")
def built(spark):
    raw = spark.createDataFrame(demo.CHAPTERS, ", ".join(f"{c} string" for c in demo.COLUMNS)).coalesce(1)
    return build(tables.chapters(raw), demo.config())


def test_counts(built):
    r = built["summary"].first()
    assert (r.source_count, r.observation_count, r.membership_count, r.inference_result_count, r.mamdani_result_count, r.evaluation_metric_count) == (5, 18, 31, 20, 7, 7)
    assert r.coverage == pytest.approx(0.888889)
    assert built["observations"].groupBy("source_id").count().orderBy("source_id").toPandas()["count"].tolist() == [4, 4, 4, 4, 2]
    assert built["memberships"].groupBy("source_id").count().orderBy("source_id").toPandas()["count"].tolist() == [8, 5, 7, 8, 3]
    assert (built["relation_nodes"].count(), built["relation_edges"].count()) == (36, 74)
    assert [r.observation_id for r in built["observations"].orderBy("observation_id").collect()] == [f"OBS_{i:06d}" for i in range(1, 19)]


def test_memberships(built):
    m = built["memberships"]
    assert sorted({r.membership for r in m.where("calculation_mode = 'overlap_integral'").collect()}) == pytest.approx([0.947721, 0.986529])
    got = {(r.variable_key, r.membership): (r.p5, r.p95) for r in m.where("p5 IS NOT NULL").collect()}
    want = {("deficiency_property.moderate", 0.62): (0.562800, 0.674862), ("blood_stasis_tendency.moderate", 0.55): (0.487274, 0.624805), ("blood_stasis_tendency.moderate", 0.64): (0.578702, 0.696305)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_inference_and_centroids(built):
    want = [
        ("SRC_001", "RULE_0001", 0.789533, None, None, 0.770749, 0.356328), ("SRC_001", "RULE_0002", 0.608560, 0.596892, 0.618968, 0.760999, 0.288420), ("SRC_002", "RULE_0001", 0.789533, None, None, 0.770749, 0.356328), ("SRC_003", "RULE_0002", 0.701046, None, None, 0.766050, 0.324142),
        ("SRC_004", "RULE_0002", 0.608560, 0.596892, 0.618968, 0.760999, 0.288420), ("SRC_004", "RULE_0003", 0.664931, None, None, 0.764094, 0.310446), ("SRC_005", "RULE_0004", 0.653600, None, None, 0.763472, 0.306090),
    ]
    fired = built["inference_results"].where("status = 'fired'").join(built["mamdani_results"], ["source_id", "consequent_entity"]).orderBy("source_id", "rule_id").collect()
    assert [(r.source_id, r.rule_id) for r in fired] == [w[:2] for w in want]
    for r, w in zip(fired, want):
        assert (r.activation, r.centroid, r.area) == pytest.approx((w[2], *w[5:]), abs=1e-6) and r.max_membership <= r.activation
        assert (r.p5, r.p95) == (w[3:5] if w[3] is None else pytest.approx(w[3:5], abs=1e-6))
    low = built["inference_results"].where("source_id = 'SRC_001' AND rule_id = 'RULE_0003'").first()
    assert (low.activation, low.p5, low.p95) == pytest.approx((0.002269, 0.002149, 0.002403), abs=1e-6) and low.missing_variables == ["pain_fixed.present"] and low.status == "below_threshold"


def test_aggregates(built):
    levels = built["aggregation_results"]
    got = {r.consequent_entity: (r.membership, r.tradition_count) for r in levels.where("level = 'global'").collect()}
    want = dict(zip([r[2] for r in demo.RULES], [(0.930778, 2), (0.804926, 2), (0.565191, 1), (0.653600, 1)]))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    quality = {r.source_id: r.quality_weight for r in levels.where("level = 'source'").collect()}
    assert [quality[f"SRC_00{i}"] for i in range(1, 6)] == pytest.approx([0.873333, 0.866667, 0.813333, 0.82, 0.853333], abs=1e-6)


def test_patterns(built):
    p = built["candidate_patterns"].orderBy("pattern_id").collect()
    assert [sum(r.size == k for r in p) for k in (2, 3, 4)] == [5, 9, 4] and len(p) == 18
    top = p[0]
    assert top.pattern_id == "PATTERN_000001" and top["items"] == ["pain_quality:cold", "relieving_factor:warmth_relieves"] and (top.support, top.lift, top.source_count) == (0.4, 2.5, 2)
    assert top.review_status == "exploratory_only" and top.source_ids == ["SRC_001", "SRC_002"] and top.book_count == 2 and top.possible_interpretation == ["寒湿痹阻", "寒凝经脉", "阳虚寒凝"]
    assert top.representative_evidence == ["SRC_001: 痛而冷；得温则缓", "SRC_002: 冷痛；温之稍安"] and top.mapping_status_summary["pain_quality:cold"] == {"mapped": 2}
    assert top.source_count_summary.startswith("2/5 sources; exploratory_only") and top.source_count_summary.endswith("source_ids_complete")


def test_evaluation_validation_and_verdict(built):
    e = {r.metric: r for r in built["evaluation_results"].collect()}
    assert (e["multi_interpretation_count_proxy"].value, e["multi_interpretation_count_proxy"].n, e["SMB-coverage-proxy"].value) == (1.4, 5, 1.0)
    assert sorted(m for m, r in e.items() if r.status == "needs_gold_standard") == ["CRP", "FCR", "FIA-chain", "FIA-local", "MIC"]
    v = built["validation_report"]
    assert v.where("severity = 'warning'").count() == 7 and v.where("severity = 'error'").count() == 0
    assert built["completion_assessment"].first().verdict == "research_ready_with_caveats"
    assert [tuple(r) for r in assess.status_counts(built["methodology_compliance"]).collect()] == [("met", len(assess.MADE_FROM))]
    audit = {r.name: (r.rows, r.status) for r in built["implementation_audit"].collect()}
    assert audit["source_units"] == (5, "filled") and audit["summary"] == (1, "filled") and set(assess.MADE_FROM) < set(audit)
    lacking = assess.methods(built["implementation_audit"].where("name <> 'rules'")).where("status = 'lacks_input'").collect()
    assert {r.name: r.lacking for r in lacking} == {"inference_results": ["rules"], "relation_edges": ["rules"]}


def test_pages(built):
    pages = {r.path: r for r in built["wiki_pages"].collect()}
    kinds = [r.page_type for r in pages.values()]
    assert {k: kinds.count(k) for k in ("source", "rule", "pattern", "tradition", "synthesis", "index", "audit")} == {"source": 5, "rule": 4, "pattern": 18, "tradition": 4, "synthesis": 1, "index": 1, "audit": 3}
    assert "entities/ENT_0001.md" in pages and "syndromes/肾虚证.md" in pages and "observations/pain_quality_cold.md" in pages
    assert "SRC_003" in pages["syndromes/肾虚证.md"].body and "PATTERN_000001" in pages["observations/pain_quality_cold.md"].body and "腰痛而冷" in pages["sources/SRC_001.md"].body
    spectrum = pages["synthesis/global_syndrome_spectrum.md"].body
    assert spectrum.index("寒湿痹阻") < spectrum.index("肾虚证") < spectrum.index("湿热下注")
    assert pages["audit/mamdani_sensitivity.md"].body.count("| SRC_") == 7


def test_long_lists_keep_every_line(spark):
    rows = spark.range(2500).select(F.lit("k").alias("key"), F.format_string("line %04d", "id").alias("l"))
    got = report.listed(rows, "key", F.col("l"), F.col("l"), "text", most=500).collect()
    assert len(got) == 5 and sorted(x for r in got for x in r.text.split("\n")) == [f"line {i:04d}" for i in range(2500)]


def test_tables_of_a_build(spark, built, tmp_path):
    small = {k: built[k] for k in ("rules", "candidate_patterns", "expert_rule_review", "source_stratification", "rule_lifecycle", "ontology_lexicon", "expert_calibration_template")}
    files.write_tables(small, str(tmp_path), "csv")
    back = files.read_table(spark, f"{tmp_path}/candidate_patterns")
    assert back.count() == 18 and back.columns[0] == "pattern_id" and json.loads(back.orderBy("pattern_id").first()["items"]) == ["pain_quality:cold", "relieving_factor:warmth_relieves"]
    assert files.read_table(spark, f"{tmp_path}/none.csv") is None and files.read_gold(spark, str(tmp_path)) == {}
    assert files.first_rows(built["source_units"], 2).count() == 2 and files.first_rows(built["source_units"], 0).count() == 5
    n = {(r.dimension, r.value): r.n for r in small["source_stratification"].collect()}
    assert n[("tradition_id", "southern_traumatology")] == 2 and n[("school_tag", "骨伤派")] == 2 and n[("school_tag", "经方系统")] == 1
    assert small["rule_lifecycle"].count() == 22 and small["ontology_lexicon"].groupBy("lexicon_section").count().orderBy("lexicon_section").toPandas()["count"].tolist() == [3, 14, 19]
    assert small["expert_calibration_template"].orderBy("calibration_id").first().feature_value == "腰部"
    # a reviewed pattern becomes a rule
    review = files.read_table(spark, f"{tmp_path}/expert_rule_review").withColumn("expert_decision", F.when(F.col("pattern_id") == "PATTERN_000001", "accepted").otherwise(F.col("expert_decision")))
    review = review.withColumns({"antecedents_json": F.lit('[{"variable": "cold_property", "threshold": "0.5"}]'), "suggested_consequent": F.lit("寒湿痹阻")})
    made = rules.load_rules(spark, demo.config(), review).where("rule_id LIKE 'RULE_FROM%'").collect()
    assert len(made) == 1 and made[0].rule_id == "RULE_FROM_PATTERN_000001" and [tuple(a) for a in made[0].antecedents] == [("cold_property", "high", 0.5, 1.0)] and made[0].source_ids == ["SRC_001", "SRC_002"]


def test_rules_of_odd_rows(spark):
    rows = [
        ("R1", "accepted", "[{'variable': 'v', 'fuzzy_set': 's', 'threshold': 0.5, 'weight': 2}, {'variable': ' '}]", "c", "0.3", None, "x；y"), ("R2", "pending", '[{"variable": "v"}]', "c", None, None, None), ("R3", None, "[]", "c", None, None, None), ("R4", " Rejected ", '[{"variable": "v"}]', "c", None, None, None),
        (None, "否", '[{"variable": "v"}]', "c", None, None, None), (" ", "yes", '[{"variable": "v"}]', " ", "nan", "draft", '["p", "q"]'), ("R7", "yes", "not a list", "c", None, None, None),
    ]
    df = spark.createDataFrame(rows, "rule_id string, expert_decision string, antecedents_json string, suggested_consequent string, suggested_rule_weight string, review_status string, source_ids string")
    got = rules.build_rules(df.withColumn("consequent", F.lit("{'entity': 'e', 'entity_type': 't'}"))).orderBy("rule_id").collect()
    assert [(r.rule_id, r.consequent_entity, r.consequent_type, r.rule_weight, r.review_status, r.source_ids, len(r.antecedents)) for r in got] == [("R1", "c", "t", 0.3, "active_rule", ["x", "y"], 1), ("RULE_UNSPECIFIED", "e", "t", 1.0, "draft", ["p", "q"], 1)]
    assert rules.build_rules(df.withColumn("antecedents", F.lit(""))).count() == 0  # a blank column hides the other
    assert rules.build_rules(df.limit(0)).count() == 0


# --- candidate patterns ---


def observations(spark, rows):
    return spark.createDataFrame([(s, k, "mapped", f"e {k}", i) for i, (s, k) in enumerate(rows)], "source_id string, observation_key string, mapping_status string, evidence_text string, seq long")


def sources(spark, n, traditions=3):
    return spark.createDataFrame([(f"S{i:03d}", f"book {i % 4}", f"t{i % traditions}") for i in range(n)], "source_id string, book_name string, tradition_id string")


LOOSE = {"min_support": 0.01, "min_lift": 0.0, "min_pmi": -9.0, "min_source_count": 1}


def test_lift_filters_the_result_alone(spark):
    rows = [(f"S{i:03d}", k) for i in range(100) for k in ("dummy", *("a", "b") * (i < 80), *("c",) * (i < 20))]
    got = {tuple(r["items"]) for r in patterns.mine_patterns(observations(spark, rows), sources(spark, 100), {**LOOSE, "min_lift": 1.3, "max_size": 3}).collect()}
    assert ("a", "b", "c") in got and ("a", "b") not in got


def test_support_counts_all_sources_and_ids_are_cut(spark):
    rows = [(f"S{i:03d}", k) for i in range(40) for k in ("A ", "b")] + [("unknown", "a"), ("unknown", "b")]
    r = patterns.mine_patterns(observations(spark, rows), sources(spark, 80), {**LOOSE, "max_source_ids_per_pattern": 5, "max_size": 2}).first()
    assert (r.support, r.source_count, r.source_ids, r.review_status) == (0.5, 40, [f"S{i:03d}" for i in range(5)], "pending") and r["items"] == ["a", "b"]
    assert r.source_count_summary.endswith("source_ids_truncated_to=5") and r.tradition_entropy == pytest.approx(1.0, abs=1e-3) and len(r.representative_evidence) == 5
    assert patterns.mine_patterns(observations(spark, rows), sources(spark, 80), {**LOOSE, "min_tradition_count": 4, "max_size": 2}).count() == 0
    assert patterns.mine_patterns(observations(spark, rows).limit(0), sources(spark, 80), LOOSE).count() == 0


def test_sizes_and_caps(spark):
    rows = [(f"S{i:03d}", k) for i in range(30) for k in "vwxyz"]
    whole = patterns.mine_patterns(observations(spark, rows), sources(spark, 30), {**LOOSE, "max_size": 0}).collect()
    assert max(r.size for r in whole) == 5 and len(whole) == 26
    top = patterns.mine_patterns(observations(spark, rows), sources(spark, 30), {**LOOSE, "max_size": 3, "top_k_patterns": 7}).collect()
    assert max(r.size for r in top) <= 3 and len(top) == 7
    baskets = spark.createDataFrame(rows, "source_id string, item string")
    assert mining.frequent_itemsets(baskets, 1, 1, pair_cap=4).count() == 4  # sizes are 2 at least
    capped = mining.frequent_itemsets(baskets, 1, 3, join_cap=2).where("size = 3").orderBy("items").collect()
    assert [r["items"] for r in capped] == [["v", "w", "x"], ["v", "w", "y"]]


def test_no_set_with_the_support_is_left_out(spark):
    rows = [(f"S{i:03d}", f"k{k:02d}") for i in range(12) for k in range(20)]
    capped = {**LOOSE, "max_size": 3, "max_pair_candidates": 30, "max_join_candidates": 20}
    for n in (12, 40):  # exploratory or not
        got = patterns.mine_patterns(observations(spark, rows), sources(spark, n), capped).select("items").collect()
        assert len({tuple(r["items"]) for r in got}) == 190 + 1140 == len(got)


def test_all_sources_of_a_pattern_are_rows_of_their_own(spark):
    rows = [(f"S{i:03d}", k) for i in range(40) for k in "ab"] + [(f"S{i:03d}", "c") for i in range(9)]
    found, whole = patterns.patterns_and_sources(observations(spark, rows), sources(spark, 80), {**LOOSE, "max_source_ids_per_pattern": 5})
    found = {tuple(r["items"]): r for r in found.collect()}
    got = {r["pattern_id"]: r["s"] for r in whole.groupBy("pattern_id").agg(F.sort_array(F.collect_list("source_id")).alias("s")).collect()}
    for items, n in ((("a", "b"), 40), (("a", "c"), 9), (("b", "c"), 9), (("a", "b", "c"), 9)):
        r = found.pop(items)
        assert got[r["pattern_id"]] == [f"S{i:03d}" for i in range(n)] and r["source_count"] == n and r["source_ids"] == got[r["pattern_id"]][:5]
    assert not found


# --- calibration, evaluation, shapes ---


def test_calibration_feeds_the_lexicon(spark):
    c = demo.config()
    tasks = calibrate.scoring_tasks(spark, c)
    scores = spark.createDataFrame([("苔黄腻", "damp_heat_property", "high", f"E{i}", s) for i, s in enumerate((0.9, 0.8, 0.85))] + [("new", "v", "s", "E1", 1.7)], "term string, variable string, fuzzy_set string, expert_id string, score double")
    rows = {r.term: r for r in calibrate.calibration(calibrate.checked_scores(scores), ["term", "variable", "fuzzy_set"]).collect()}
    r = rows["苔黄腻"]
    assert (r.median, r.p5, r.p95, r.icc, r.experts, rows["new"].median, rows["new"].icc) == (0.85, 0.805, 0.895, 0.9, 3, 1.0, None)
    merged = calibrate.merge_calibration(tasks, calibrate.calibration(scores, ["term", "variable", "fuzzy_set"]))
    new = calibrate.calibrated_config(c, merged)["linguistic_values"]
    assert new["苔黄腻"]["maps_to"]["damp_heat_property"]["prior_membership"] == 0.85 and new["苔黄腻"]["maps_to"]["damp_heat_property"]["review_status"] == "expert_reviewed"
    assert new["new"]["maps_to"]["v"]["status"] == "expert_calibrated" and new["冷痛"] == c["linguistic_values"]["冷痛"]
    with pytest.raises(ValueError, match="score"):
        calibrate.checked_scores(scores.drop("score"))
    panel = calibrate.panel_calibration(tasks).collect()
    assert len(panel) == 14 and {(r.review_status, r.calibration_source, r.score_count) for r in panel} == {("llm_roleplay_reviewed", "llm_roleplay_panel", 3)}
    shaped = calibrate.calibrated_config(c, calibrate.panel_calibration(tasks))
    assert sorted(r.item for r in validate.ignored_priors(spark, shaped).collect()) == ["冷痛.cold_property", "得温则缓.cold_property"]


def test_metrics_with_gold(spark, built):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    gold = {
        "expert_memberships.csv": t([("SRC_005", "tongue:yellow_greasy", "damp_heat_property", "high", "0.81")], "source_id string, standard_observation string, variable string, fuzzy_set string, expert_membership string"),
        "expert_inference.csv": t([("SRC_005", "湿热下注", 0.7536)], "source_id string, consequent_entity string, expert_membership double"),
        "expected_interpretations.csv": t([("SRC_001", "肾虚证;寒湿痹阻|x"), ("SRC_009", '["肾虚证"]'), ("SRC_002", " ")], "source_id string, expected_consequents string"),
        "modern_mappings.csv": t([("腰痛", "low back pain; sciatica"), ("none", "x")], "entity_name string, expected_modern_mapping string"),
        "conditional_relations.csv": t([("c", 0.5, 0.9), ("d", 0.5, 0.5)], "condition string, model_membership double, expert_membership double"),
        "chain_paths.csv": t([("a", 0.5), ("b", None)], "case_id string, path_overlap double"),
    }
    e = evaluate.evaluation(built["memberships"], built["inference_results"], built["entities"], gold).collect()
    assert [r.metric for r in e] == ["FCR", "FIA-local", "MIC", "SMB", "CRP", "FIA-chain", "multi_interpretation_count_proxy"]
    assert [r.value for r in e] == pytest.approx([0.95, 0.9, (2 / 3 + 0) / 2, 0.25, 0.8, 0.5, 1.4], abs=1e-6)
    short = evaluate.evaluation(built["memberships"], built["inference_results"], built["entities"], {"chain_paths.csv": gold["chain_paths.csv"].drop("path_overlap"), "conditional_relations.csv": gold["conditional_relations.csv"].limit(0)}).collect()
    assert {r.metric: r.status for r in short}["FIA-chain"] == {r.metric: r.status for r in short}["CRP"] == "needs_gold_standard"


def test_shapes_fall_back(spark):
    r = spark.createDataFrame([("R1", "e", "t"), ("R2", "x", "t"), ("R3", "x", "y")], "rule_id string, consequent_entity string, consequent_type string")
    shape = lambda s: {x.rule_id: x.a for x in infer.shapes_of(r, s).collect()}
    assert shape({"e": [0.1, 1, 1, 1], "t": [0.2, 1, 1, 1], "default": [0.3, 1, 1, 1]}) == {"R1": 0.1, "R2": 0.2, "R3": 0.3}
    assert shape({"e": [0.1, 1, 1, 1]}) == {"R1": 0.1, "R2": 0.45, "R3": 0.45}


def test_config_errors(spark):
    c = demo.config()
    del c["entities"], c["fuzzy_sets"]["pain_fixed"]
    assert sorted((r.item, r.code) for r in validate.config_findings(spark, c).collect()) == [("RULE_0003", "rule_references_missing_fuzzy_set"), ("entities", "missing_config_section")]
    assert validate.config_findings(spark, demo.config()).count() == 0


def test_rules_listed_twice_count_once(spark):
    fired = spark.createDataFrame([("s", "R", "c", 0.5)], "source_id string, rule_id string, consequent_entity string, activation double")
    r = spark.createDataFrame([("R", 0.2, 0.1), ("R", 0.9, None)], "rule_id string, rule_weight double, expert_acceptance_rate double").coalesce(1)
    got = aggregate.by_source(fired, r, spark.createDataFrame([("s", "t")], "source_id string, tradition_id string")).first()
    assert got.n_rules == 1 and got.total_weight == 0.9


# --- chunks ---


RECORD = "seq long, timestamp string, source_id string, chunk_index int, chunk_total int, chunk_sha256 string, status string, observations array<struct<feature:string,feature_value:string,evidence_text:string,extraction_confidence:double>>, n_observations int, elapsed_sec double, usage map<string,long>, finish_reason string, attempt int, error string"


def record(seq, source, chunk, status, found=(), **more):
    return {"seq": seq, "timestamp": "t", "source_id": source, "chunk_index": chunk, "chunk_total": 2, "chunk_sha256": f"h{chunk}", "status": status, "observations": [{"feature": "f", "feature_value": v, "evidence_text": "e", "extraction_confidence": 0.5} for v in found], "n_observations": len(found), "elapsed_sec": 1.0, "usage": {"total_tokens": 7} if status == "success" else {}, "finish_reason": "stop", "attempt": 1, "error": None if status == "success" else "x" * 400, **more}


LOG = [record(1, "a", 1, "error"), record(2, "a", 1, "success", "pq"), record(3, "a", 1, "error"), record(4, "a", 2, "success", "qr"), record(5, "b", 1, "error")]


def test_chunk_log(spark):
    log = spark.createDataFrame(LOG, RECORD)
    assert [(r.source_id, r.chunk_index, r.row, r.feature_value) for r in chunks.assemble(log).orderBy("source_id", "chunk_index", "row").collect()] == [("a", 1, 0, "p"), ("a", 1, 1, "q"), ("a", 2, 1, "r")]
    assert chunks.usage(chunks.latest_records(log)).agg(F.sum("total_tokens")).first()[0] == 14
    assert [r.source_id for r in chunks.errors(chunks.latest_records(log)).collect()] == ["b"]
    planned = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2"), ("b", 1, "h1"), ("b", 2, "h2"), ("c", 1, "h1")], "source_id string, chunk_index int, chunk_sha256 string")
    assert tuple(chunks.extraction_report(planned, log).first()) == (3, 5, 2, 1, 2, 4)
    assert {(r.source_id, r.status, len(r.errors or "")) for r in chunks.source_progress(planned, log).collect()} == {("a", "success", 0), ("b", "error", 300), ("c", "no_chunks", 0)}
    manifest = dict.fromkeys(chunks.MANIFEST, "x")
    chunks.check_manifest(None, manifest)
    chunks.check_manifest(manifest, dict(manifest))
    with pytest.raises(ValueError, match="chunk_chars"):
        chunks.check_manifest(manifest, {**manifest, "chunk_chars": "y"})


def test_cut_points_by_brute_force():
    def plain(text, size, overlap):
        out, at = [], 0
        while len(text) - at > size:
            places = range(at + min(max(200, size // 3), size - 1), at + size)
            line = [p for p in places if text[p] == "\n"]
            stop = [p + 1 for p in places if text[p] in "。；;."]
            end = max(line) if line else max(stop) if stop else at + size
            out.append((at, end))
            at = max(end - overlap, at + 1)
        return [*out, (at, len(text))]

    import random

    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choices("ab.。;\n", [9, 9, 0.02, 0.02, 0.02, 0.02], k=r.randint(1, 3000)))
        size, overlap = r.randint(1, 900), r.randint(0, 100)
        if overlap < size:
            assert chunks.cut_points(text, size, overlap) == plain(text, size, overlap)


# --- sources ---


def test_numbers_of_any_order(spark):
    rows = [(f"SRC_{i:03d}", i % 7) for i in range(500)] + [("ZZZ", None)]
    d = spark.createDataFrame(rows, "source_id string, k int").repartition(5)
    got = extract.number(d, [F.col("k").desc_nulls_last(), "source_id"], "n", "X").orderBy("n").collect()
    want = sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], [-ord(c) for c in r[0]]), reverse=True)
    assert [(r.source_id, r.k) for r in got] == want and [r.n for r in got] == [f"X_{i:06d}" for i in range(1, 502)]
    assert extract.number(d.limit(0), ["k"], "n").count() == 0


def test_chapter_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿id,text,quality\n,"two\nlines ""quoted""",1\nx,,2\n', encoding="utf-8")
    r = tables.read_chapters(spark, f"{tmp_path}/c.csv").orderBy("source_seq").collect()
    assert [(x.source_id, x.text_original) for x in r] == [("SRC_0001", 'two\nlines "quoted"'), ("x", "")]
    with pytest.raises(ValueError):
        tables.read_chapters(spark, "c.json")


def test_ids_follow_the_rows_over_many_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text("text\n" + "\n".join(f"t{i}{j}" for j in range(5)))
    r = tables.chapters(spark.read.csv(str(tmp_path), header=True).repartition(4)).collect()
    assert sorted(x.source_id for x in r) == [f"SRC_{i:04d}" for i in range(1, 21)]
