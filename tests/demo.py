"""The demonstration corpus and configuration that the golden numbers belong to
(fixed values)."""

CHAPTERS = [
    ("SRC_001", "石氏伤科", "卷一", "论腰痛", "1", "清", "石氏医家", "腰痛而冷，得温则缓，久病不愈。", "医案", "腰痛", "骨伤派", "江南医学传统", "southern_traumatology", "traumatology_text", "shi_lineage", "0.82", "0.94", "0.86"),
    ("SRC_002", "伤寒论辑义", "卷三", "寒湿腰痛", "2", "清", "经方医家", "腰冷痛，遇寒益甚，温之稍安。", "条文", "腰痛", "伤寒派;经方系统", "北方传统", "shanghan_tradition", "classic_formula_text", "zhang_zhongjing_lineage", "0.88", "0.90", "0.82"),
    ("SRC_003", "明清杂病论", "卷二", "久病腰痛", "3", "明", "综合医家", "久病腰痛，腰膝酸软，脉弦。", "医案", "腰痛", "明清综合医家", "江南医学传统", "mingqing_miscellaneous", "miscellaneous_disease_text", "mingqing_lineage", "0.76", "0.88", "0.80"),
    ("SRC_004", "骨伤经验集", "卷四", "瘀血腰痛", "4", "清", "骨伤医家", "腰痛刺痛不移，夜间加重，久病不愈。", "医案", "腰痛", "骨伤派", "岭南医学传统", "southern_traumatology", "traumatology_text", "trauma_lineage", "0.78", "0.86", "0.82"),
    ("SRC_005", "温病条辨摘义", "卷一", "湿热腰痛", "5", "清", "温病医家", "腰痛兼苔黄腻，遇热烦甚。", "条文", "腰痛", "温病派", "江南医学传统", "warm_disease_tradition", "warm_disease_text", "wu_jutong_lineage", "0.84", "0.89", "0.83"),
]
COLUMNS = ["source_id", "book_name", "volume_name", "chapter_title", "chapter_order", "dynasty", "author", "text_original", "text_type", "topic_hint", "school_tag", "region_tag", "tradition_id", "text_family", "citation_family", "source_authority", "text_integrity", "semantic_clarity"]

FUZZY_SETS = [
    ("cold_property", "high", [0.60, 0.78, 1.00, 1.00]),
    ("warmth_relieves", "present", [0.50, 0.70, 1.00, 1.00]),
    ("kidney_related", "high", [0.55, 0.72, 1.00, 1.00]),
    ("musculoskeletal_location", "present", [0.45, 0.65, 1.00, 1.00]),
    ("chronicity", "high", [0.55, 0.75, 1.00, 1.00]),
    ("deficiency_property", "moderate", [0.35, 0.50, 0.70, 0.85]),
    ("blood_stasis_tendency", "moderate", [0.35, 0.50, 0.72, 0.88]),
    ("damp_heat_property", "high", [0.62, 0.80, 1.00, 1.00]),
    ("pain_fixed", "present", [0.50, 0.70, 1.00, 1.00]),
]
MAPPING = {
    "腰": "pain_location:waist", "腰痛": "pain_location:waist", "腰部": "pain_location:waist", "腰痛而冷": "pain_quality:cold", "痛而冷": "pain_quality:cold", "冷痛": "pain_quality:cold", "得温则缓": "relieving_factor:warmth_relieves", "温之稍安": "relieving_factor:warmth_relieves", "遇寒加重": "aggravating_factor:cold_worsens", "遇寒则甚": "aggravating_factor:cold_worsens",
    "久病": "course:chronic", "久病不愈": "course:chronic", "不愈": "course:chronic", "刺痛不移": "pain_quality:stabbing_fixed", "刺痛": "pain_quality:stabbing_fixed", "夜间加重": "aggravating_factor:night_worse", "苔黄腻": "tongue:yellow_greasy", "脉弦": "pulse:wiry", "腰膝酸软": "symptom:waist_knee_soreness",
}
#: term, feature, variable, fuzzy set, prior, icc, linguistic set
VALUES = [
    ("腰部", "pain_location", "kidney_related", "high", 0.72, 0.82, None),
    ("腰部", "pain_location", "musculoskeletal_location", "present", 0.86, 0.80, None),
    ("冷痛", "pain_quality", "cold_property", "high", 0.85, None, [0.70, 0.86, 1.00, 1.00]),
    ("得温则缓", "relieving_factor", "cold_property", "high", 0.82, None, [0.64, 0.82, 1.00, 1.00]),
    ("得温则缓", "relieving_factor", "warmth_relieves", "present", 0.92, 0.86, None),
    ("久病", "disease_course", "chronicity", "high", 0.88, 0.81, None),
    ("久病", "disease_course", "deficiency_property", "moderate", 0.62, 0.68, None),
    ("久病", "disease_course", "blood_stasis_tendency", "moderate", 0.55, 0.66, None),
    ("刺痛不移", "pain_quality", "blood_stasis_tendency", "moderate", 0.82, 0.78, None),
    ("刺痛不移", "pain_quality", "pain_fixed", "present", 0.88, 0.80, None),
    ("夜间加重", "aggravating_factor", "blood_stasis_tendency", "moderate", 0.64, 0.70, None),
    ("苔黄腻", "tongue", "damp_heat_property", "high", 0.86, 0.82, None),
    ("腰膝酸软", "symptom", "kidney_related", "high", 0.90, 0.84, None),
    ("腰膝酸软", "symptom", "deficiency_property", "moderate", 0.72, 0.78, None),
]
#: id, antecedents (variable, fuzzy set, threshold, weight), consequent, weight, acceptance
RULES = [
    ("RULE_0001", [("cold_property", "high", 0.70, 0.50), ("warmth_relieves", "present", 0.60, 0.30), ("musculoskeletal_location", "present", 0.50, 0.20)], "寒湿痹阻", 0.84, 0.80),
    ("RULE_0002", [("kidney_related", "high", 0.70, 0.50), ("chronicity", "high", 0.60, 0.30), ("deficiency_property", "moderate", 0.50, 0.20)], "肾虚证", 0.82, 0.78),
    ("RULE_0003", [("chronicity", "high", 0.60, 0.35), ("blood_stasis_tendency", "moderate", 0.50, 0.45), ("pain_fixed", "present", 0.50, 0.20)], "瘀血阻络", 0.78, 0.76),
    ("RULE_0004", [("damp_heat_property", "high", 0.70, 1.00)], "湿热下注", 0.76, 0.74),
]
ENTITIES = [("ENT_0001", "腰痛", "症状/病症", "low back pain"), ("ENT_0002", "肾虚证", "证候", "kidney deficiency pattern"), ("ENT_0003", "寒湿痹阻", "证候", "cold-damp obstruction pattern")]


def config() -> dict:
    c = {
        "membership_calculation": {"numerical_integration": {"points": 200}},
        "mamdani_sensitivity": {"enabled": True, "points": 200},
        "consequent_fuzzy_sets": {"default": {"points": [0.45, 0.70, 1.00, 1.00]}, "syndrome": {"points": [0.45, 0.70, 1.00, 1.00]}},
        "mapping_policy": {"trigger_review_if_confidence_above": 0.85},
        "uncertainty_propagation": {"n_samples": 200, "icc_threshold": 0.75, "random_seed": 20260531},
        "aggregation": {"source_rule_discount_gamma": 0.5, "default_tradition_delta": 1.0, "tradition_independence_weights": {"shanghan_tradition": 1.0, "southern_traumatology": 0.85, "mingqing_miscellaneous": 0.85, "warm_disease_tradition": 1.0}},
        "candidate_pattern_filter": {"max_size": 0, "min_support": 0.001, "min_source_count": 20, "min_tradition_count": 3, "min_lift": 2.0, "min_pmi": 1.0, "top_k_patterns": 0, "fisher_test": False, "max_source_ids_per_pattern": 100, "max_pair_candidates": 200000, "max_join_candidates": 100000},
        "wiki_output": {"max_candidate_pattern_pages": 1000},
        "fuzzy_sets": {}, "observation_mapping": MAPPING, "linguistic_values": {},
        "seed_rules": [{"rule_id": i, "rule_name": i, "antecedents": [{"variable": v, "fuzzy_set": f, "threshold": t, "weight": w} for v, f, t, w in ants], "consequent": {"entity": e, "entity_type": "syndrome"}, "rule_weight": w, "expert_acceptance_rate": a, "review_status": "active_rule", "rule_origin": "seed_rule"} for i, ants, e, w, a in RULES],
        "entities": [{"entity_id": i, "entity_name": n, "entity_type": k, "normalized_name": n, "modern_mapping": m} for i, n, k, m in ENTITIES],
    }
    for v, f, p in FUZZY_SETS:
        c["fuzzy_sets"].setdefault(v, {})[f] = {"points": p}
    for term, feature, variable, name, prior, icc, shape in VALUES:
        m = {"fuzzy_set": name, "prior_membership": prior, "status": "bootstrap_prior", "icc": icc}
        c["linguistic_values"].setdefault(term, {"feature": feature, "maps_to": {}})["maps_to"][variable] = m | ({"linguistic_set": {"points": shape}} if shape else {})
    return c
