"""Line deduplication by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import free_names


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with the text freed of lines in windows seen before, and with
    ``n_lines`` and ``lines_removed``, or, where ``docs`` has these names, with
    what ``free_names`` makes of them; its own columns stay as they are.

    A window is ``window`` consecutive lines, trimmed of blanks and tabs, blank
    lines left out. Of equal windows anywhere in the table the one of smallest
    (id, position) stays; the lines of all later ones go, overlapping windows
    merged. Blank lines stay. Texts with fewer lines than a window, null and
    empty texts stay as they are (null: 0 lines). Of rows equal in id and text
    all but one are later occurrences: they lose every line in a window. Of
    other rows with one id, the smaller text hash comes first; null ids come
    first of all. An empty table gives an empty one. A text is never cut: the
    longest row is what a task must hold.

    Windows meet by 128 bits of hash. The first place of each is aggregated
    before the shuffle; the join back is one that the engine may split where
    a window is very frequent. A document's covered lines are the only group
    that is collected.
    """
    name = free_names(docs.columns, ("n_lines", "lines_removed"))
    text = F.col(f"`{text_col}`")
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{id_col}`")).alias("ih"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    full = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("p"), F.btrim(x, F.lit(" \t\r")).alias("x")))
    full = F.transform(
        F.filter(full, lambda s: s["x"] != ""),
        lambda s: F.struct(s["p"].alias("p"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(window), s["x"]).alias("b"))
    )
    listed = row.where(F.col("text").contains("\n")).select("id", "ih", "th", full.alias("h")).withColumn("n", F.size("h") - (window - 1)).where("n > 0")
    zipped = F.arrays_zip(*[F.slice("h", k + 1, F.col("n")).alias(f"h{k}") for k in range(window)])
    each = listed.select("id", "ih", "th", F.explode(zipped).alias("w"))
    field = lambda k, f: F.col("w")[f"h{k}"][f]
    each = each.select(
        "id", "ih", "th", field(0, "p").alias("at"), F.array(*[field(k, "p") for k in range(window)]).alias("covers"),
        F.xxhash64(*[field(k, "a") for k in range(window)]).alias("w1"), F.xxhash64(*[field(k, "b") for k in range(window)]).alias("w2"),
    )
    first = each.groupBy("w1", "w2").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    place = F.struct("id", "th", "at")
    later = each.join(first, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    drop = later.select("ih", "th", F.explode("covers").alias("p")).groupBy("ih", "th").agg(F.collect_set("p").alias("drop"))
    # rows of one id and text meet in one task already, so numbering them costs no shuffle
    again = F.row_number().over(Window.partitionBy("ih", "th").orderBy("th")) > 1
    joined = row.join(drop, ["ih", "th"], "left").withColumn("again", again)
    line = _lines(F.col("text"))
    filled = F.filter(F.transform(line, lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) != "", i)), lambda i: i.isNotNull())
    joined = joined.withColumn("drop", F.when(~F.col("again"), F.col("drop")).otherwise(F.when(F.size(filled) >= window, filled)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col("drop"))
    left = joined.select(
        "row", "text",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(line, i)), "\n")).alias("new"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("gone")
    )
    out = [F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return left.select(
        *out, F.when(F.col("text").isNull(), 0).otherwise(F.size(line)).cast("long").alias(name["n_lines"]),
        F.greatest(F.col("gone"), F.lit(0)).cast("long").alias(name["lines_removed"])
    )
