"""Pages as one table (page_type, path, body): Markdown texts made by grouping.

A list of many lines is cut by hash into pages of about PAGE_LINES, so that no
group grows with the table and no line is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import normal_item, safe_filename

PAGE_LINES = 1000
BOUNDARY = "Memberships and conclusions are formal degrees of evidence in texts, not medical advice."
#: Folder of an entity by what its type contains, in this order (fixed values).
FOLDERS = [("方", "formulas"), ("药", "herbs"), ("证", "syndromes"), ("病机", "mechanisms"), ("治法", "methods"), ("方法", "methods")]


def cells(*columns: Column) -> Column:
    """A row of a Markdown table; nulls are dashes."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))


def head(*names: str) -> str:
    return "| " + " | ".join(names) + " |\n" + "|---" * len(names) + "|"


def listed(rows: DataFrame, key: str, order: Column, line: Column, name: str, most: int = PAGE_LINES) -> DataFrame:
    """(key, part, name): the lines of each key, in order; keys of more than
    ``most`` lines in parts (from 0) by hash of the line."""
    d = rows.select(F.col(key).alias(key), F.struct(order.alias("o"), line.alias("l")).alias("s"))
    parts = d.groupBy(key).agg(F.ceil(F.count("*") / most).alias("__parts")).where("__parts > 1")
    d = d.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("s"), F.col("__parts")), F.lit(0)).cast("int"))
    return d.groupBy(key, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["l"]), "\n").alias(name))


def together(key: str, *lists: DataFrame) -> DataFrame:
    """(key, part, the lists' names): part by part, so the first page of a key
    has the first part of each list, and further ones what is left."""
    return reduce(lambda a, b: a.join(b, [key, "part"], "full"), lists)


def pages(kind: str | Column, folder: str | Column, base: Column, body: Column, part: Column | None = None) -> list[Column]:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    end = F.lit("") if part is None else F.when(part > 0, F.concat(F.lit("_"), part.cast("string"))).otherwise("")
    return [
        as_column(kind).alias("page_type"), F.concat(as_column(folder), F.lit("/"), safe_filename(base), end, F.lit(".md")).alias("path"),
        body.alias("body")
    ]


def text(*parts) -> Column:
    """Paragraphs; texts are literals, nulls are empty."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def one_page(rows: DataFrame, kind: str, path: str, title: str, header: str, order: Column, line: Column) -> DataFrame:
    """All rows on a page, and on more if they are many."""
    d = listed(rows.withColumn("__k", F.lit(path)), "__k", order, line, "lines")
    one = rows.sparkSession.range(1).select(F.lit(path).alias("__k"), F.lit(0).alias("part"))
    d = d.join(one, ["__k", "part"], "full")
    end = F.when(F.col("part") > 0, F.concat(F.lit("_"), F.col("part").cast("string"))).otherwise("")
    return d.select(
        F.lit(kind).alias("page_type"), F.concat(F.lit(path), end, F.lit(".md")).alias("path"),
        text(f"# {title}", header, F.col("lines"), "", BOUNDARY).alias("body")
    )


def source_pages(sources: DataFrame, observations: DataFrame, memberships: DataFrame, results: DataFrame) -> DataFrame:
    """A page per source with its text, observations, memberships and conclusions."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    o = listed(
        observations, "source_id", F.col("observation_id"),
        cells(F.col("observation_id"), F.col("feature"), F.col("standard_observation"), two("extraction_confidence"), F.col("evidence_text")),
        "o"
    )
    m = listed(
        memberships, "source_id", F.col("membership_id"),
        cells(F.col("standard_observation"), F.col("variable_key"), two("membership"), F.col("calculation_mode")), "m"
    )
    r = listed(
        results.where("status = 'fired'"), "source_id", F.col("rule_id"),
        cells(F.col("consequent_entity"), two("activation"), F.col("p5"), F.col("p95"), F.col("rule_id")), "r"
    )
    d = sources.join(together("source_id", o, m, r), "source_id", "left")
    part = F.coalesce("part", F.lit(0))
    field = lambda n, c: F.concat(F.lit(f"- {n}: "), F.coalesce(c.cast("string"), F.lit("")))
    body = text(
        F.concat_ws(
            " ", F.lit("#"), "book_name", "volume_name", "chapter_title"
        ), field("source", F.col("source_id")), field("type", F.col("text_type")), field("tradition", F.col("tradition_id")), field("schools", F.array_join("school_tag", ", ")), field("regions", F.array_join("region_tag", ", ")), field("topic", F.col("topic_hint")),
        "\n## Text", F.when(part == 0, F.col("text_original")), "\n## Observations", head(
            "id", "feature", "standard", "confidence", "evidence"
        ), F.col("o"), "\n## Memberships", head("observation", "variable", "membership", "mode"), F.col("m"), "\n## Conclusions", head("conclusion", "activation", "p5", "p95", "rule"), F.col("r"), "", BOUNDARY,
    )
    return d.select(*pages("source", "sources", F.col("source_id"), body, part))


def rule_pages(rules: DataFrame) -> DataFrame:
    ants = F.array_join(F.transform("antecedents", lambda a: cells(a["variable"], a["fuzzy_set"], a["threshold"], a["weight"])), "\n")
    numbers = F.concat_ws(
        "\n",
        *[cells(F.lit(c), F.col(c)) for c in ("rule_weight", "support", "confidence", "lift", "pmi", "source_count", "tradition_count")]
    )
    note = F.coalesce(F.nullif("expert_disagreement_note", F.lit("")), F.nullif("applicable_context", F.lit("")), F.lit("to be added"))
    body = text(
        F.concat_ws(" ", F.lit("#"), "rule_id", "rule_name"), F.concat_ws(", ", "rule_origin", "pattern_id", "review_status"),
        "\n## Antecedents", head("variable", "set", "threshold", "weight"), ants, "\n## Consequent", F.col("consequent_entity"),
        "\n## Statistics", head("measure", "value"), numbers, "\n## Remarks", note
    )
    return rules.select(*pages("rule", "rules", F.col("rule_id"), body))


def pattern_pages(patterns: DataFrame, most: int = 1000) -> DataFrame:
    """Pages of the first ``most`` patterns, and a notice if there are more."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    numbers = F.concat_ws(
        "\n",
        *[cells(F.lit(c), F.col(c)) for c in ("support", "confidence", "lift", "pmi", "fisher_p", "jaccard", "size", "source_count", "book_count", "tradition_count", "source_diversity", "tradition_entropy")]
    )
    status = F.to_json("mapping_status_summary")
    body = text(
        F.concat_ws(" ", F.lit("#"), "pattern_id"), bullets("items"), "\n## Statistics", head("measure", "value"), numbers, "\n## Sources",
        F.array_join("source_ids", ", "), F.col("source_count_summary"), F.array_join("book_names", ", "),
        F.array_join("tradition_ids", ", "), status, "\n## Evidence", bullets("representative_evidence"), "\n## Suggestions",
        F.array_join("possible_interpretation", ", "), "\n## Review", F.concat_ws(", ", "status", "review_status")
    )
    shown = patterns.orderBy("pattern_id").limit(most).select(*pages("pattern", "patterns", F.col("pattern_id"), body))
    notice = patterns.agg(F.count("*").alias("n")).where(F.col("n") > most).select(
        F.lit("pattern_limit_notice").alias("page_type"), F.lit("patterns/candidate_pattern_page_limit.md").alias("path"),
        F.concat(
            F.lit(f"# Patterns\n\nPages of the first {most} of "), F.col("n").cast("string"),
            F.lit(" patterns; the table candidate_patterns has all.")
        ).alias("body")
    )
    return shown.unionByName(notice)


def conclusion_lists(levels: DataFrame, rules: DataFrame) -> DataFrame:
    """(consequent_entity, part, a, u): a conclusion's levels and its rules.
    Sources have pages of their own, so only traditions and the corpus are listed."""
    a = listed(
        levels.where("level <> 'source'"), "consequent_entity", F.struct("level", "tradition_id"),
        cells(F.col("level"), F.col("tradition_id"), F.col("membership"), F.col("evidence_count")), "a"
    )
    u = listed(rules, "consequent_entity", F.col("rule_id"), cells(F.col("rule_id"), F.col("rule_name"), F.col("rule_weight"), F.col("review_status")), "u")
    return together("consequent_entity", a, u)


def entity_pages(entities: DataFrame, levels: DataFrame, rules: DataFrame) -> DataFrame:
    kind = F.coalesce("entity_type", F.lit(""))
    folder = F.coalesce(*[F.when(F.contains(kind, F.lit(n)), f) for n, f in FOLDERS], F.lit("entities"))
    d = entities.join(conclusion_lists(levels, rules), F.col("entity_name") == F.col("consequent_entity"), "left")
    fields = [F.concat(F.lit(f"- {c}: "), F.coalesce(c, F.lit(""))) for c in ("entity_id", "entity_type", "normalized_name", "synonyms", "ancient_terms", "modern_mapping", "parent_category", "review_status")]
    body = text(
        F.concat_ws(" ", F.lit("#"), "entity_name"), *fields, "\n## Definition", F.col("definition"), "\n## Aggregates",
        head("level", "tradition", "membership", "evidence"), F.col("a"), "\n## Rules", head("rule", "name", "weight", "status"),
        F.col("u"), "", BOUNDARY
    )
    return d.select(
        *pages(
            F.regexp_replace(folder, "s$", ""), folder, F.coalesce(F.nullif("entity_id", F.lit("")), "entity_name", F.lit("entity")), body,
            F.coalesce("part", F.lit(0))
        )
    )


def conclusion_pages(results: DataFrame, levels: DataFrame, rules: DataFrame, entities: DataFrame) -> DataFrame:
    """A page for every conclusion that a rule could reach, fired or not."""
    names = results.select("consequent_entity").union(levels.select("consequent_entity")).where("consequent_entity <> ''").distinct()
    s = listed(
        results.where("status = 'fired'"), "consequent_entity", F.struct("source_id", "rule_id"),
        cells(F.col("source_id"), F.col("activation"), F.col("rule_id"), F.array_join("supporting_variables", ", ")), "s"
    )
    named = entities.select(
        F.explode(F.array_distinct(F.array("entity_name", "normalized_name"))).alias("name"), "definition", "modern_mapping"
    ).groupBy("name").agg(F.max(F.struct("definition", "modern_mapping")).alias("e"))
    d = names.join(
        together("consequent_entity", s, conclusion_lists(levels, rules)), "consequent_entity", "left"
    ).join(named, F.col("consequent_entity") == F.col("name"), "left")
    body = text(
        F.concat_ws(" ", F.lit("#"), "consequent_entity"), F.col("e.definition"), F.col("e.modern_mapping"), "\n## Sources",
        head("source", "activation", "rule", "supported by"), F.col("s"), "\n## Aggregates",
        head("level", "tradition", "membership", "evidence"), F.col("a"), "\n## Rules", head("rule", "name", "weight", "status"),
        F.col("u"), "", BOUNDARY
    )
    return d.select(*pages("syndrome", "syndromes", F.col("consequent_entity"), body, F.coalesce("part", F.lit(0))))


def patterns_of_items(patterns: DataFrame, most: int = 10) -> DataFrame:
    """(item, pattern_id, items, lift, pmi, source_count, place): the ``most``
    patterns of each item by lift, then sources."""
    each = patterns.select(F.explode("items").alias("item"), "pattern_id", "items", "lift", "pmi", "source_count")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lift"), F.desc("source_count"), "pattern_id"))
    return each.withColumn("place", rank).where(F.col("place") <= most)


def observation_pages(observations: DataFrame, memberships: DataFrame, patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """A page for every standard observation: its variables, its patterns (by
    the items' normal form) and the rules made of these."""
    keys = observations.groupBy("observation_key").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))
    keys = keys.withColumn("item", normal_item(F.col("observation_key")))
    m = memberships.select(F.col("standard_observation").alias("observation_key"), "variable_key", "membership", "status").distinct()
    m = listed(m, "observation_key", F.struct("variable_key", "membership"), cells(F.col("variable_key"), F.col("membership"), F.col("status")), "m")
    top = patterns_of_items(patterns)
    p = listed(
        top, "item", F.col("place"),
        cells(F.col("pattern_id"), F.array_join(F.array_except("items", F.array("item")), ", "), F.col("lift"), F.col("pmi"), F.col("source_count")),
        "p"
    )
    made = patterns.select(F.explode("items").alias("item"), "pattern_id").join(
        rules.select("pattern_id", "rule_id", "rule_name", "review_status"), "pattern_id"
    )
    u = listed(made, "item", F.col("rule_id"), cells(F.col("rule_id"), F.col("rule_name"), F.col("review_status")), "u")
    of_items = keys.select("observation_key", "item").join(together("item", p, u), "item").drop("item")
    d = keys.join(together("observation_key", m, of_items), "observation_key", "left")
    body = text(
        F.concat_ws(" ", F.lit("#"), "observation_key"), "\n## Variables", head("variable", "membership", "status"), F.col("m"),
        "\n## Patterns", head("pattern", "with", "lift", "pmi", "sources"), F.col("p"), "\n## Rules", head("rule", "name", "status"),
        F.col("u"), "\n## Evidence",
        F.concat(F.col("n").cast("string"), F.lit(" times in "), F.col("sources").cast("string"), F.lit(" sources"))
    )
    return d.select(*pages("observation", "observations", F.col("observation_key"), body, F.coalesce("part", F.lit(0))))


def tradition_pages(sources: DataFrame, levels: DataFrame) -> DataFrame:
    books = listed(
        sources, "tradition_id", F.struct("book_name", "chapter_title", "source_id"),
        F.concat_ws(" ", F.lit("-"), "book_name", "chapter_title"), "b"
    )
    a = listed(
        levels.where("level = 'tradition'"), "tradition_id", F.col("consequent_entity"),
        cells(F.col("consequent_entity"), F.col("membership"), F.col("evidence_count")), "a"
    )
    d = together("tradition_id", books, a).join(sources.select("tradition_id").distinct(), "tradition_id", "left_semi")
    return d.select(
        *pages(
            "tradition", "traditions", F.col("tradition_id"),
            text(
                F.concat_ws(" ", F.lit("#"), "tradition_id"), F.col("b"), "\n## Conclusions", head("conclusion", "membership", "evidence"),
                F.col("a"), "", BOUNDARY
            ),
            F.col("part")
        )
    )


def all_pages(t: dict[str, DataFrame], pattern_pages_most: int = 1000) -> DataFrame:
    """Every page of a build's tables."""
    levels, whole = t["aggregation_results"], t["aggregation_results"].where("level = 'global'")
    by_membership, row = F.struct(-F.col("membership"), F.col("consequent_entity")), cells(
        F.col("consequent_entity"), F.col("membership"), F.col("evidence_count"), F.col("tradition_count")
    )
    table = head("conclusion", "membership", "evidence", "traditions")
    boundary = levels.sparkSession.range(1).select(
        F.lit("audit").alias("page_type"), F.lit("audit/formal_boundary.md").alias("path"), F.lit(f"# Boundary\n\n{BOUNDARY}").alias("body")
    )
    parts = [
        source_pages(
            t["source_units"], t["observations"], t["memberships"], t["inference_results"]
        ), rule_pages(t["rules"]), pattern_pages(t["candidate_patterns"], pattern_pages_most), entity_pages(t["entities"], levels, t["rules"]),
        conclusion_pages(t["inference_results"], levels, t["rules"], t["entities"]), observation_pages(
            t["observations"], t["memberships"], t["candidate_patterns"], t["rules"]
        ), tradition_pages(t["source_units"], levels),
        one_page(
            whole, "synthesis", "synthesis/global_syndrome_spectrum", "Conclusions of the corpus", table, by_membership, row
        ), one_page(whole, "index", "index", "Overview", table, by_membership, row),
        one_page(
            t["mamdani_results"], "audit", "audit/mamdani_sensitivity", "Sensitivity",
            head("source", "conclusion", "centroid", "greatest", "area", "rules"), F.struct("source_id", "consequent_entity"),
            cells(F.col("source_id"), F.col("consequent_entity"), F.col("centroid"), F.col("max_membership"), F.col("area"), F.array_join("rules", ", "))
        ),
        one_page(
            t["evaluation_results"], "audit", "audit/evaluation_metrics", "Metrics", head("metric", "value", "n", "status", "gold"),
            F.col("metric"), cells(F.col("metric"), F.col("value"), F.col("n"), F.col("status"), F.col("required_gold_file"))
        ), boundary,
    ]
    return reduce(DataFrame.unionByName, parts)
