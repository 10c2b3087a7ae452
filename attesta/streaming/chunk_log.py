"""The chunk log: files of JSON lines without any order but their own.

Records carry no number, so their place is read with them: the file, the byte
at which the reader's split begins, and the line's place in that split. Files
are split as any other and read by whatever the session reads. As a stream, the
record that counts of each chunk is kept as state by key, so state grows with
chunks, not with records, and restarts or files read twice change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The log's format. Fields that may come as numbers or text are read as text.
RECORD = (
    "timestamp string, source_id string, chunk_index string, chunk_total int, chunk_sha256 string, status string, "
    "observations array<struct<feature:string,feature_value:string,evidence_text:string,extraction_confidence:string>>, "
    "n_observations int, elapsed_sec double, usage map<string,long>, finish_reason string, attempt string, error string"
)
PLACED = "value string, file string, block long, line long"
#: What is kept of a chunk: whether it succeeded, where its record stood, and the record.
KEPT = "ok boolean, file string, block long, line long, value string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _lines(reader, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return reader.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))


def _records(lines: DataFrame) -> DataFrame:
    """Records of lines that are JSON with a source and a chunk number from 1
    on; others, as torn ones, go. seq is the record's place."""
    r = F.from_json("value", RECORD)
    number: Column = F.expr("try_cast(try_cast(r.chunk_index AS double) AS int)")
    d = lines.select(r.alias("r"), F.struct("file", "block", "line").alias("seq"), "value").withColumn("index", number)
    d = d.where((F.col("r.source_id") != "") & (F.col("index") > 0))
    names = [f.strip().split(" ")[0] for f in RECORD.split(", ")]
    columns = [F.col("index").alias("chunk_index") if n == "chunk_index" else F.expr("try_cast(r.attempt AS int)").alias(n) if n == "attempt" else F.col(f"r.{n}") for n in names]
    return d.select("seq", *columns, "value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log with their place as ``seq``; files follow each
    other by path."""
    return _records(_lines(spark.read, path).withColumn("line", F.monotonically_increasing_id())).drop("value")


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a log as a stream, with their place."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + b.num_rows), pa.int64())], [*b.schema.names, "line"])
            n += b.num_rows

    return _records(_lines(spark.readStream, folder).mapInArrow(place, PLACED))


class Latest(StatefulProcessor):
    """Keeps the latest record of a chunk; an error never replaces a success."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.kept.get()
        best = None if old is None else tuple(old)
        for r in rows:
            found = (r["ok"], r["file"], r["block"], r["line"], r["value"])
            best = found if best is None or found[:4] > best[:4] else best
        if old is None or best != tuple(old):
            self.kept.update(best)
            yield Row(source_id=key[0], chunk_index=key[1], ok=best[0], value=best[4])

    def close(self) -> None:
        pass


def keep_latest(log: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run the stream over the files there are and keep the record that counts
    of each chunk in the state of ``checkpoint``."""
    spark = log.sparkSession
    keyed = log.select("source_id", "chunk_index", F.coalesce(F.col("status") == "success", F.lit(False)).alias("ok"), "seq.*", "value")
    kept = keyed.groupBy("source_id", "chunk_index").transformWithState(
        Latest(), "source_id string, chunk_index int, ok boolean, value string", "Update", "None"
    )
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The record that counts of each chunk, from the state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    return _records(state.select("value.*")).drop("value")
