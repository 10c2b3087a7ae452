"""Documents to training sequences in five stages, each written and reread.

``run(spark, sf_dir)`` applies STAGES to the table documents. Each stage takes
(spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import jaccard, langid, line_dedup, mixing, packing
from attesta.llm.queries import quality_of, tokenizer_path
from attesta.llm.storage import free_names, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null texts and texts
    without a letter. ``lang`` becomes what the classifier says; where no row
    has a language to learn from, it stays as it is. Null ids, repeated rows
    and columns of any name are kept as they are; an empty table stays empty."""
    model = langid.fit(docs, F.lit(True))
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    pred = free_names(docs.columns, langid.ADDED)["lang_pred"]
    found = langid.identify(docs, model)
    return found.where(F.col(pred) != "und").select(*[F.col(pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; documents of which nothing but
    blanks is left go too. ``n_chars`` counts what is left; other columns stay
    as they are. Nulls, ties and repeated rows: as ``dedup_lines`` says."""
    removed = free_names(docs.columns, ("n_lines", "lines_removed"))["lines_removed"]
    left = line_dedup.dedup_lines(docs).where((F.col(removed) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles link at 80 percent, the one of
    smallest doc_id stays, those without an id last; of rows equal in id and
    text, one. Rows of one id with other texts stand and fall together.
    Documents without words link with nothing and stay."""
    id_, hash_ = F.col("doc_id").cast("long"), F.xxhash64("text")
    # ids that rows without one get come after all others and depend on the text alone
    key = F.coalesce(id_, F.shiftrightunsigned(hash_, 2).bitwiseOR(F.lit(1 << 62))).alias("key")
    name = free_names(docs.columns, ("key", "hash"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], key.alias(name["key"]), hash_.alias(name["hash"]))
    groups = jaccard.similar_components(docs.select(key, "text"), id_col="key", n=5, percent=80)
    # written first, so that the engine knows how few they are and need not shuffle the texts
    others = written(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name["key"])).distinct(), "others")
    both = list(name.values())
    repeated = written(keyed.groupBy(*both).count().where("count > 1").select(*both), "repeated")
    once = keyed.join(others, name["key"], "left_anti")
    if repeated.limit(1).count():
        once = once.join(repeated, both, "left_anti").unionByName(once.join(repeated, both, "left_semi").dropDuplicates(both))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; documents without
    words go. Nulls, ties and repeated rows: as ``mix`` says; columns of any
    name are kept as they are."""
    times = free_names(docs.columns, ("size", "source_size", "target", "times", "taken"))["times"]
    mixed = mixing.mix(docs, ratings=quality_of(spark, sf_dir), unrated=1.5).where(F.col(times) > 0)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of powers of two; a null
    text is one id. Repeated rows are packed each."""
    return packing.number_sequences(packing.decompose(docs, tokenizer_path()))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard", keep_one_of_similar),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the classifier, the exact similarity join or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
