"""The splitter and the extraction as functions that SQL can call per row:

    SELECT d.doc_id, c.* FROM documents d, LATERAL split_chunks(d.text, 1800, 80) c
    SELECT d.doc_id, f.* FROM documents d, LATERAL find_patterns(d.text, '[["needle", ...]]') f

``register(spark)`` makes both known. Rows are handed on one by one, so a text
of any length is in memory once, beside the places where it is cut.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

CHUNK = StructType().add("chunk_index", "integer").add("chunk_total", "integer").add("chunk", "string").add("chunk_sha256", "string")
FOUND = StructType().add("pattern_idx", "integer").add("feature", "string").add("feature_value", "string").add("evidence_text", "string").add(
    "extraction_confidence", "double"
)


def _constant(a: AnalyzeArgument, name: str) -> object:
    if not a.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return a.value


class SplitChunks:
    """(text, size, overlap) to chunks as ``plan_chunks`` cuts them: numbered
    from 1, trimmed, none of a blank or null text; size 0 or less: one chunk."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _constant(size, "size"), _constant(overlap, "overlap")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        from attesta.operators.chunks import cut_points

        t = (text or "").strip()
        spans = [(0, len(t))] if size <= 0 or len(t) <= size else cut_points(t, size, overlap)
        kept = [(a, b) for a, b in spans if not t[a:b].isspace() and a < b]
        for i, (a, b) in enumerate(kept, 1):
            chunk = t[a:b].strip()
            yield i, len(kept), chunk, hashlib.sha256(chunk.encode()).hexdigest()


@dataclass
class Patterns(AnalyzeResult):
    """An analysis that hands the checked patterns on to the tasks."""

    patterns: str = "[]"


class FindPatterns:
    """(text, patterns) to the patterns found in it, of one feature and value
    the first. ``patterns``: a JSON list of [needle, feature, value, evidence,
    confidence]; it is read and checked once, when the query is planned."""

    def __init__(self, analyzed: Patterns):
        self.patterns = json.loads(analyzed.patterns)

    @staticmethod
    def analyze(text: AnalyzeArgument, patterns: AnalyzeArgument) -> AnalyzeResult:
        rows = json.loads(str(_constant(patterns, "patterns")))
        if not all(isinstance(r, list) and len(r) == 5 and float(r[4]) >= 0 for r in rows):
            raise ValueError("a pattern is [needle, feature, value, evidence, confidence]")
        return Patterns(FOUND, patterns=json.dumps(rows))

    def eval(self, text: str, patterns: str) -> Iterator[tuple]:
        seen = set()
        for i, (needle, feature, value, evidence, confidence) in enumerate(self.patterns):
            if needle in (text or "") and (feature, value) not in seen:
                seen.add((feature, value))
                yield i, feature, value, evidence, float(confidence)


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_chunks", udtf(SplitChunks))
    spark.udtf.register("find_patterns", udtf(FindPatterns))
