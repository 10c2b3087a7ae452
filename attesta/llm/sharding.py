"""Shards of equal bytes by a k-d tree over metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import drop, free_names, written

#: A point's key in a dimension: COORD bits of its coordinate, GROUP bits of its
#: group's hash. A histogram resolves DIGIT bits of the rest; a cut may miss by
#: this share of a shard.
COORD, GROUP, DIGIT, MISS = 22, 40, 16, 0.0005
BITS = COORD + GROUP


def text_number(text: Column) -> Column:
    """Short texts as numbers in the order of their first six bytes."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def gapless(df: DataFrame, group: str, order: list[str], name: str, parts: int = 256) -> DataFrame:
    """``df`` with a number from 0 without gaps inside each ``group``. Groups
    are cut into ``parts`` by hash of ``order``; sums of the parts' counts give
    each part its first number, so no task numbers a whole group."""
    d = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    n = d.groupBy(F.col(group).alias("__of"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__of").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    d = d.withColumn("__rank", rank)
    return d.join(
        n, (F.col(group) == F.col("__of")) & (F.col("__part") == F.col("__p"))
    ).withColumn(name, (F.col("__first") + F.col("__rank")).cast("long")).drop("__of", "__p", "__part", "__first", "__rank")


def _begun(points: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """The cuts to be found: for each of ``nodes`` (__node, n) that has points
    its widest dimension, the bytes it needs left of the cut, and the digits of
    its keys' own range, from which the search starts."""
    coordinate = [F.shiftright(F.col("__x")[i], GROUP) for i in range(dims)]
    ends = [F.array(*[f(F.col("__x")[i]) for i in range(dims)]).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))]
    wide = F.array(*[F.max(c) - F.min(c) for c in coordinate]).alias("wide")
    g = points.join(nodes, "__node").groupBy("__node", "n").agg(F.sum("__size").alias("w"), wide, *ends)
    g = g.withColumn("dim", F.array_position("wide", F.array_max("wide")).cast("int"))
    low, high = F.element_at("least", F.col("dim")), F.element_at("most", F.col("dim"))
    need = F.col("w") * F.expr("n div 2") / F.col("n")
    shift = F.greatest(F.lit(0), F.length(F.bin(high - low)) - DIGIT).cast("int")
    zero = F.lit(0).cast("long")
    return g.select(
        "__node", "n", "dim", need.alias("need"), F.lit(0).alias("stage"), shift.alias("shift"), low.alias("k0"), zero.alias("k1"),
        (F.col("w") == 0).alias("done")
    )


def _narrowed(points: DataFrame, state: DataFrame, target: float) -> DataFrame:
    """``state`` after one more digit of each open cut: the digit in which the
    running sum of a node's bytes meets its need. A cut is found when its digit
    is light or a single row's, or in the last digit of the own hash, which
    only matters where one group's bytes ask for a cut."""
    d = points.join(state.where("NOT done").drop("n", "done"), "__node")
    key, late = F.element_at("__x", F.col("dim")), F.col("stage") == 1
    d = d.where(~late | (key == F.col("k0"))).withColumn("rest", F.when(late, F.col("__own") - F.col("k1")).otherwise(key - F.col("k0")))
    d = d.withColumn("digit", F.expr("shiftright(rest, shift)")).where((F.col("digit") >= 0) & (F.col("digit") < 1 << DIGIT))
    sums = d.groupBy("__node", "need", "digit").agg(F.sum("__size").alias("w"), F.count("*").alias("c"))
    sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("__node").orderBy("digit")))
    met = sums.where("upto >= need").groupBy("__node").agg(F.min(F.struct("digit", "w", "upto", "c")).alias("m"))
    s = state.join(met, "__node", "left")
    found, w, shift = F.col("m").isNotNull() & ~F.col("done"), F.col("m.w"), F.col("shift")
    need = F.col("need") - (F.col("m.upto") - w)
    light = (w <= MISS * target) | (F.col("m.c") == 1) | (late & (shift == 0))
    step = F.expr("shiftleft(m.digit, shift)") + F.when(light & (need > w / 2), F.expr("shiftleft(1L, shift)")).otherwise(0)
    turn = found & ~light & (shift == 0)  # all digits of the key are known: on to the own hash
    return s.select(
        "__node", "n", "dim", F.when(found, need).otherwise(F.col("need")).alias("need"), F.when(turn, 1).otherwise(F.col("stage")).alias("stage"),
        F.when(turn, BITS - DIGIT).when(found & ~light, F.greatest(F.lit(0), shift - DIGIT)).otherwise(shift).cast("int").alias("shift"),
        F.when(
            found & ~late, F.col("k0") + step
        ).otherwise(F.col("k0")).alias("k0"), F.when(found & late, F.col("k1") + step).otherwise(F.col("k1")).alias("k1"),
        (F.col("done") | F.col("m").isNull() | light).alias("done"),
    )


def kd_shards(
    rows: DataFrame, dims: list[Column], size: Column, group: Column, own: Column, shards: int | None = None,
    target_bytes: int | None = None
) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in it), or,
    where ``rows`` has such names, with what ``free_names`` makes of them; its
    own columns stay.

    A node that stands for n shards is cut so that n // 2 of n parts of its
    bytes lie left of the cut, along the dimension in which its points are
    widest, as a share of the whole table's width, ties to the earlier one; a
    node of one shard is a leaf. ``shards`` fixes the number of leaves, else
    they are as many as bring them to ``target_bytes``. ``dims``: numbers (null
    counts as the least). ``group`` and ``own``: 64-bit hashes; points equal in
    the dimension stay together by group, and a group is only cut where the
    bytes ask for it. Rows equal in all of these are told apart by nothing and
    stay together. Null sizes count as 0. Empty table: no rows.

    A cut misses by MISS of a shard or half a row's bytes, whichever is more
    (rows aren't divided), and its children halve that; so a shard is at most
    the largest row plus twice that share away from the mean.

    Each level is a few aggregations over a slim table (no texts) in the
    shared folder, which holds the points' nodes and is replaced by the next
    level's. A node is named by the first shard it stands for. Nodes and their
    cuts are a table too, a row each; the driver only learns whether all cuts
    are found.
    """
    name = free_names(rows.columns, ("shard", "slot"))
    kept = {f"__c{i}": c for i, c in enumerate(rows.columns)}
    raw = {f"__d{i}": F.coalesce(d.cast("double"), F.lit(float("-inf"))) for i, d in enumerate(dims)}
    p = rows.select(
        *[F.col(f"`{c}`").alias(k) for k, c in kept.items()], *[d.alias(k) for k, d in raw.items()],
        F.coalesce(size, F.lit(0)).cast("long").alias("__size"), F.shiftrightunsigned(group, 64 - GROUP).alias("__g"),
        F.shiftrightunsigned(own, 64 - BITS).alias("__own")
    )
    finite = [F.when(F.abs(F.col(k)) < float("inf"), F.col(k)) for k in raw]
    facts = p.agg(
        F.sum("__size").alias("all"), *[F.min(x).alias(f"l{i}") for i, x in enumerate(finite)],
        *[F.max(x).alias(f"h{i}") for i, x in enumerate(finite)]
    ).first()
    n = shards or max(1, -(-(facts["all"] or 0) // (target_bytes or 1 << 30)))
    target = (facts["all"] or 0) / n
    keys = []
    for i, x in enumerate(finite):
        lo, hi = facts[f"l{i}"] or 0.0, facts[f"h{i}"] or 0.0
        at = F.coalesce(F.floor((x - lo) / ((hi - lo) or 1.0) * ((1 << COORD) - 1)).cast("long"), F.lit(0).cast("long"))
        keys.append(F.shiftleft(at, GROUP).bitwiseOR(F.col("__g")))
    points = written(p.select(F.lit(0).cast("long").alias("__node"), *kept, F.array(*keys).alias("__x"), "__size", "__own"), "points")
    nodes = points.sparkSession.range(1).select(F.col("id").alias("__node"), F.lit(n).cast("long").alias("n"))
    state = None
    for _ in range((n - 1).bit_length()):
        begun = written(_begun(points, nodes.where("n > 1"), len(dims)), "cuts")
        while begun.where("NOT done").limit(1).count():
            narrowed = written(_narrowed(points, begun, target), "cuts")
            drop(begun)
            begun = narrowed
        cut = points.join(begun.select("__node", "n", "dim", "k0", "k1"), "__node", "left")
        beyond = F.struct(F.element_at("__x", F.col("dim")), F.col("__own")) >= F.struct("k0", "k1")
        right = F.when(F.col("n").isNotNull() & beyond, F.expr("n div 2")).otherwise(0)
        new = written(cut.withColumn("__node", F.col("__node") + right).select(*points.columns), "points")
        for old in (points, *([state] if state is not None else [])):
            drop(old)
        points, state = new, begun
        halves = F.array(
            F.struct(F.col("__node"), F.expr("n div 2").alias("n")),
            F.struct((F.col("__node") + F.expr("n div 2")).alias("__node"), F.expr("n - n div 2").alias("n"))
        )
        nodes = state.select(F.explode(halves).alias("h")).select("h.*")
    out = gapless(points.select(*kept, F.col("__node").cast("int").alias("__shard"), "__own", "__x"), "__shard", ["__own", "__x", *kept], "__slot")
    return out.select(*[F.col(k).alias(c) for k, c in kept.items()], F.col("__shard").alias(name["shard"]), F.col("__slot").alias(name["slot"]))
