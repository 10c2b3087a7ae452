"""Chapter tables of any column names to one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import filled, first_filled, split_tags
from ..operators.extract import number, number_as_read

#: Names under which each column may come (fixed values of the input format).
ALIASES = {
    "source_id": ["source_id", "id", "编号", "章节id", "条目id"],
    "book_name": ["book_name", "书名", "古籍名称", "书籍", "book", "title"],
    "volume_name": ["volume_name", "卷名", "卷", "volume", "册"],
    "chapter_title": ["chapter_title", "章节标题", "章节", "篇名", "章名", "chapter", "section_title", "标题"],
    "chapter_order": ["chapter_order", "章节序号", "序号", "order", "chapter_index", "index"],
    "dynasty": ["dynasty", "朝代", "年代"],
    "author": ["author", "作者"],
    "text_original": ["text_original", "original_text", "原文", "正文", "内容", "chapter_text", "text", "古籍原文", "分章内容", "段落"],
    "text_punctuated": ["text_punctuated", "标点原文", "点校文本"],
    "text_modern": ["text_modern", "现代文", "白话文", "译文"],
    "chapter_summary": ["chapter_summary", "摘要", "小结", "summary"],
    "text_type": ["text_type", "文本类型", "类型"],
    "topic_hint": ["topic_hint", "主题", "主题提示", "topic"],
    "school_tag": ["school_tag", "流派", "学派"],
    "region_tag": ["region_tag", "地域", "地区"],
    "tradition_id": ["tradition_id", "学术传统", "传统"],
    "text_family": ["text_family", "文献类型家族", "文献类型"],
    "citation_family": ["citation_family", "引用谱系", "版本谱系"],
    "notes": ["notes", "备注", "说明"],
}
EMPTY_BY_DEFAULT = ("text_punctuated", "text_modern", "chapter_summary", "notes")
QUALITY = ("source_authority", "text_integrity", "semantic_clarity")
#: What the normalizer puts where a text is missing (fixed values); elsewhere ``uncertain``.
DEFAULTS = {"text_type": "古籍章节", "topic_hint": "中医古籍", "notes": "", "text_family": "古籍章节", "text_punctuated": "", "text_modern": "", "chapter_summary": ""}
#: Columns of a normalized table, in order (fixed values).
COLUMNS = [
    "source_id", "book_name", "volume_name", "chapter_title", "chapter_order", "dynasty", "author", "text_original", "text_punctuated",
    "text_modern", "chapter_summary", "text_type", "topic_hint", "notes", "school_tag", "region_tag", "tradition_id", "text_family",
    "citation_family", *QUALITY
]


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (or Parquet) table of chapters in the schema of ``chapters``."""
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif path.endswith(".csv"):
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")
    mark = [c for c in raw.columns if c.startswith("\ufeff")]
    return chapters(raw.withColumnRenamed(mark[0], mark[0][1:]) if mark else raw)


def chapters(raw: DataFrame) -> DataFrame:
    """One row per source with all columns, whatever names they came under.
    Without any column for the text, the longest cell of those not recognised
    counts. Blank ids become SRC_ and the row's number; ``source_seq`` is that
    number less one."""
    have = {t: [F.col(f"`{n}`") for n in names if n in raw.columns] for t, names in ALIASES.items()}
    used = {n for names in ALIASES.values() for n in names}
    rest = [c for c in raw.columns if c not in used and c not in QUALITY]
    d = number_as_read(raw, "__row").withColumn("source_seq", F.col("__row") - 1)
    cols = {}
    for t, c in have.items():
        cols[t] = first_filled(c, "" if t in EMPTY_BY_DEFAULT or t.startswith("text_o") else "uncertain")
    if not have["text_original"] and rest:
        cells = [
            F.struct(
                F.length(F.coalesce(filled(F.col(f"`{c}`")), F.lit(""))).alias("n"), F.lit(-i).alias("i"),
                F.coalesce(filled(F.col(f"`{c}`")), F.lit("")).alias("t")
            ) for i,
            c in enumerate(rest)
        ]
        cols["text_original"] = (F.greatest(*cells) if len(cells) > 1 else cells[0])["t"]
    cols["source_id"] = F.coalesce(*[filled(c) for c in have["source_id"]], F.format_string("SRC_%04d", F.col("source_seq") + 1))
    cols["chapter_order"] = F.coalesce(*[c.try_cast("double").try_cast("int") for c in have["chapter_order"]], F.lit(None).cast("int"))
    for t in ("school_tag", "region_tag"):
        cols[t] = split_tags(cols[t])
    for q in QUALITY:
        cols[q] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(q).try_cast("double"), F.lit(1.0)))) if q in raw.columns else F.lit(0.5)
    return d.select("source_seq", *[c.alias(t) for t, c in cols.items()]).withColumn("quality", (F.col(QUALITY[0]) + F.col(QUALITY[1]) + F.col(QUALITY[2])) / 3)


def pick_column(columns: list[str], names: list[str]) -> str | None:
    """The column that equals a name, else contains one, case ignored."""
    low = {c.lower(): c for c in reversed(columns)}
    for n in names:
        if n.lower() in low:
            return low[n.lower()]
    return next((c for n in names for c in columns if n.lower() in c.lower()), None)


def normalize(raw: DataFrame, book: str, preserve_quality: bool = False, defaults: dict[str, str] = DEFAULTS) -> tuple[DataFrame, dict]:
    """A table of recognised columns in fixed order, and a report. Without a
    column for the text the one of longest texts counts. Blank ids and titles
    are filled from the position, blank orders are numbered among themselves,
    other blanks get their default, rows without text go, repeated ids are
    counted, quality is 0.8 unless preserved."""
    picked = {t: pick_column(raw.columns, names) for t, names in ALIASES.items()}
    d = number_as_read(raw, "__seq")
    if picked["text_original"] is None:
        free = [c for c in raw.columns if c not in picked.values()]
        if not free:
            raise ValueError("no column holds the text")
        size = d.agg(
            *[
                F.struct(
                    F.coalesce(F.avg(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0.0)).alias("m"),
                    F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias("x"), F.lit(c).alias("c")
                ).alias(f"s{i}") for i,
                c in enumerate(free)
            ]
        ).first()
        picked["text_original"] = max(size)["c"]
    col = lambda t: filled(F.col(f"`{picked[t]}`")) if picked[t] else F.lit(None).cast("string")
    out = {t: F.coalesce(col(t), F.lit(defaults.get(t, "uncertain"))) for t in ALIASES}
    out["source_id"] = F.coalesce(col("source_id"), F.format_string("SRC_%06d", F.col("__seq")))
    out["book_name"] = F.coalesce(col("book_name"), F.lit(book))
    out["chapter_title"] = F.coalesce(col("chapter_title"), F.format_string("chapter_%06d", F.col("__seq")))
    out["text_original"] = F.coalesce(col("text_original"), F.lit(""))
    order = col("chapter_order").try_cast("double").try_cast("int")
    d = d.select(
        "__seq", order.alias("__order"), *[c.alias(t) for t, c in out.items() if t != "chapter_order"],
        *[(F.col(q) if preserve_quality and q in raw.columns else F.lit(0.8)).alias(q) for q in QUALITY]
    )
    fill = number(d.where("__order IS NULL").select("__seq"), ["__seq"], "__fill")
    d = d.join(fill, "__seq", "left").withColumn("chapter_order", F.coalesce("__order", F.col("__fill").cast("int")))
    by_id = d.groupBy("source_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("text_original") != "", 1)).alias("kept"))
    n = by_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("kept"), F.lit(0)).alias("rows_out"),
        F.count(F.when(F.col("kept") > 1, 1)).alias("duplicate_ids")
    ).first()
    return d.where("text_original <> ''").select(*COLUMNS), {**n.asDict(), "columns": picked}
