"""Chunked, resumable extraction: planning, the log and the assembly."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import clamp01
from .extract import number

#: Marks after which a chunk may end (fixed values).
STOPS = "。；;."
#: What a log depends on (fixed names of its manifest).
MANIFEST = ("input_sha256", "chunk_chars", "chunk_overlap", "max_observations_per_chunk", "model_label")


def cut_points(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters, each ending at the last newline,
    else after the last stop, of its back part; the next starts ``overlap``
    before that and always further on.

    All places where a chunk may end are listed once, in order; each chunk
    looks up the last one inside its window."""
    lines = [m.start() for m in re.finditer("\n", text)]
    stops = [m.end() for m in re.finditer(f"[{re.escape(STOPS)}]", text)]

    def last(places: list[int], low: int, high: int) -> int | None:
        i = bisect_right(places, high)
        return places[i - 1] if i and places[i - 1] >= low else None

    front, spans, start = max(200, size // 3), [], 0
    while len(text) - start > size:
        low, high = start + min(front, size - 1), start + size
        end = last(lines, low, high - 1) or last(stops, low + 1, high) or high
        spans.append((start, end))
        start = max(start + 1, end - max(0, overlap))
    return [*spans, (start, len(text))]


def plan_chunks(sources: DataFrame, key: str = "source_id", text: str = "text", size: int = 1800, overlap: int = 80) -> DataFrame:
    """key, chunk_index (from 1), chunk_total, chunk and its SHA-256. Texts are
    trimmed; blank ones have no chunk."""

    def split(t: str | None) -> list[str]:
        t = (t or "").strip()
        if not t or size <= 0 or len(t) <= size:
            return [t] if t else []
        return [c for c in (t[a:b].strip() for a, b in cut_points(t, size, overlap)) if c]

    split = F.udf(split, "array<string>", useArrow=False)  # a hundred texts at once, not ten thousand
    c = sources.select(F.col(key).alias(key), split(text).alias("chunks"))
    e = c.select(key, F.size("chunks").alias("chunk_total"), F.posexplode("chunks").alias("at", "chunk"))
    return e.select(key, (F.col("at") + 1).alias("chunk_index"), "chunk_total", "chunk", F.sha2("chunk", 256).alias("chunk_sha256"))


def latest_records(log: DataFrame, key: str = "source_id") -> DataFrame:
    """The record that counts of each chunk: the latest, but no error
    supersedes a success. Aggregated before the shuffle."""
    order = F.struct((F.col("status") == "success").alias("ok"), "seq", "chunk_sha256")
    return log.groupBy(F.col(key).alias("__k"), F.col("chunk_index").alias("__c")).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def pending_chunks(planned: DataFrame, records: DataFrame, key: str = "source_id") -> DataFrame:
    """Planned chunks without a success of the same content."""
    done = latest_records(records, key).where("status = 'success'").select(key, "chunk_index", "chunk_sha256")
    return planned.join(done, [key, "chunk_index", "chunk_sha256"], "left_anti")


def source_progress(planned: DataFrame, records: DataFrame, key: str = "source_id") -> DataFrame:
    """Per source: chunks, successes, errors, status and the errors' texts."""
    latest = latest_records(records, key)
    g = latest.groupBy(key).agg(
        F.sum((F.col("status") == "success").cast("int")).alias("ok"), F.sum((F.col("status") != "success").cast("int")).alias("failed"),
        F.sort_array(F.collect_list(F.when(F.col("status") != "success", F.struct("chunk_index", F.substring("error", 1, 300).alias("e"))))).alias("errs")
    )
    total = planned.groupBy(key).agg(F.count("*").alias("chunks"))
    j = total.join(g, key, "left")
    status = F.when(F.col("ok").isNull(), "no_chunks").when(
        (F.col("ok") > 0) & (F.col("failed") > 0), "partial_success"
    ).when(F.col("failed") > 0, "error").otherwise("success")
    return j.select(
        key, "chunks", F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("failed", F.lit(0)).alias("failed"), status.alias("status"),
        F.substring(F.array_join(F.transform("errs", lambda s: s["e"]), " | "), 1, 1000).alias("errors")
    )


def usage(records: DataFrame, key: str = "source_id") -> DataFrame:
    """One row per record with usage: its counts as columns."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return records.where("size(usage) > 0").select(
        key, "chunk_index", "status", "attempt", "elapsed_sec", "finish_reason",
        *[F.coalesce(F.col("usage")[n], F.lit(0).cast("long")).alias(n) for n in names]
    )


def errors(records: DataFrame, key: str = "source_id") -> DataFrame:
    """The failed records."""
    return records.where("status <> 'success'").select(key, "chunk_index", "attempt", "error")


def extraction_report(planned: DataFrame, records: DataFrame, key: str = "source_id") -> DataFrame:
    """One row: sources, chunks planned, done, failed and pending, and the
    observations of the chunks done."""
    latest = latest_records(records, key)
    state = planned.select(key, "chunk_index").join(
        latest.select(key, "chunk_index", "status", F.size("observations").alias("found")), [key, "chunk_index"], "left"
    )
    n = lambda c: F.count(F.when(c, 1))
    return state.agg(
        F.countDistinct(key).alias("sources"), F.count("*").alias("chunks"), n(F.col("status") == "success").alias("done"),
        n(F.col("status") != "success").alias("failed"), n(F.col("status").isNull()).alias("pending"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.greatest("found", F.lit(0)))), F.lit(0)).alias("observations")
    )


def check_manifest(old: dict | None, new: dict) -> None:
    """A log may only be resumed with the input and parameters it was begun with."""
    changed = sorted(k for k in MANIFEST if old is not None and old.get(k) != new.get(k))
    if changed:
        raise ValueError(f"the log was begun with other values of: {', '.join(changed)}")


def assemble(records: DataFrame, key: str = "source_id") -> DataFrame:
    """Observations of the successful chunks in order of chunk and row; of
    equal ones in a source the first stays."""
    e = latest_records(records, key).where("status = 'success'").select(key, "chunk_index", F.posexplode("observations").alias("row", "o"))
    e = e.select(key, "chunk_index", "row", "o.*")
    w = Window.partitionBy(key, "feature", "feature_value", "evidence_text").orderBy("chunk_index", "row")
    return e.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def assemble_numbered(records: DataFrame, sources: DataFrame, key: str = "source_id", seq: str = "source_seq") -> DataFrame:
    """The observations of ``assemble`` with observation_id (``OBS_000001`` on)
    in order of ``seq`` of their source, chunk and row. ``sources``: (key, seq);
    observations of other sources go. Confidence is clamped to [0, 1], 0.5
    where it isn't a number. Numbers come from ranges, not from one task."""
    e = assemble(records, key).join(sources.select(key, seq), key)
    e = e.withColumn("extraction_confidence", clamp01(F.col("extraction_confidence"), 0.5))
    return number(e, [seq, "chunk_index", "row"], "observation_id", "OBS")
