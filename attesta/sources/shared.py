"""Tables written once into the shared folder, so that a lost executor never
costs more than the tasks it held."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may go without the setting; it gets a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/attesta-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/attesta-" not in folder:
            raise ValueError(f"not a table of this library: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes (as JSON) up to which a table counts as small.
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` as a written table, to be broadcast if it has no more rows and
    bytes than these; else the engine picks the join."""
    t = written(df, "small")
    seen = t.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(t) if seen["n"] <= rows and (seen["bytes"] or 0) <= size else t


def beside(t: DataFrame, n: int | None = None) -> DataFrame:
    """``t`` (of ``n`` rows, else they are counted) as a side of a join:
    broadcast up to SMALL_ROWS, else sorted and merged. Left to itself the
    engine goes by the bytes of files, which Parquet packs so well that the
    driver would get many times as much."""
    return F.broadcast(t) if (t.count() if n is None else n) <= SMALL_ROWS else t.hint("merge")


#: Rows of a part of what is sorted to be joined.
PART_ROWS = 1 << 17


def parts_for(df: DataFrame) -> int:
    """Parts of so many rows that ``df`` fills, no fewer than tasks run at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
