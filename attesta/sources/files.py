"""Input tables that may be absent, and output tables for other programs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evaluate import GOLD


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with header, all columns texts, or Parquet; None if it isn't there."""
    try:
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        d = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    mark = [c for c in d.columns if c.startswith("\ufeff")]
    return d.withColumnRenamed(mark[0], mark[0][1:]) if mark else d


def read_gold(spark: SparkSession, folder: str | None) -> dict[str, DataFrame]:
    """Those of the gold tables that the folder has, by file name."""
    found = {f: read_table(spark, f"{folder}/{f}") for f in GOLD} if folder else {}
    return {f: d for f, d in found.items() if d is not None}


def first_rows(df: DataFrame, n: int, order: str = "source_seq") -> DataFrame:
    """The first ``n`` rows (0: all) for a trial run."""
    return df.orderBy(order).limit(n) if n > 0 else df


def flat(df: DataFrame) -> DataFrame:
    """``df`` with nested columns as JSON texts."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table under its name. ``csv``: nested values as JSON, a header and
    a byte order mark in each part, also where a table has no rows."""
    for name, d in tables.items():
        if form == "csv":
            d = flat(d)
            d.withColumnRenamed(d.columns[0], "\ufeff" + d.columns[0]).write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"', emptyValue="")
        else:
            d.write.mode("overwrite").parquet(f"{folder}/{name}")
