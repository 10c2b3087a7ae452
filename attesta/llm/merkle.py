"""A manifest of the rows of a table: one hash tree per group and one over the
groups' roots, kept as a table of nodes by level.

Leaves stand in sorted runs. A pass reads one level in order, in blocks whose
nodes share an ancestor, and adds the levels up to it; so a billion leaves take
a few passes. Proofs go the other way: a pass scans the levels of its blocks
together with what is above each block, and finds every sibling by coordinate.
No task holds more than a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .storage import drop, free_names, new_path, written

#: Leaves of a block, the most that a task holds at once.
BLOCK = 1024
NODE = "grp string, pos long, n long, hash string"
PROOF = "array<struct<before:string,after:string>>"


def digest(*columns: Column | str) -> Column:
    """SHA-256 in hex of the values in order: ``-`` for a null, else the number
    of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(c: Column) -> Column:
    """A text for each value of a group; in order of the values' bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (grp and more) with pos (from 0, in ``order`` within grp) and
    n (leaves of the grp), written.

    Rows are dealt into ranges and sorted there, whatever share of them one
    group has. Each range's first place of each group follows from the numbers
    of rows before it: one row a range and group."""
    own = leaves.columns
    runs = leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    runs = written(runs.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), "leaf-runs")
    counts = runs.groupBy("grp", "run").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")
    starts = counts.select("grp", "run", shift.alias("shift"), F.sum("k").over(whole).alias("n"))
    placed = written(runs.join(starts, ["grp", "run"]).select(*own, (F.col("at") + F.col("shift")).alias("pos"), "n"), "leaves")
    drop(runs)
    return placed


def height(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    powers = [F.lit(fanout**i).cast("long") for i in range(63) if fanout**i < 1 << 63]
    return F.size(F.filter(F.array(*powers), lambda p: p < n))


def levels_of(block: int, fanout: int) -> int:
    """Levels over a block of so many leaves, at least one."""
    k = 1
    while fanout ** (k + 1) <= block:
        k += 1
    return k


def join_up(hashes: list[str], fanout: int) -> list[str]:
    """The next level: each run of ``fanout`` becomes one, the last may be shorter."""
    return [hashlib.sha256("".join(hashes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(hashes), fanout)]


@dataclass
class Tree:
    """A tree per group: its leaves (grp, pos, n, hash and more) and its nodes,
    (grp, pos, n, hash) in folders by level. A pass covers ``step`` levels."""

    leaves: DataFrame
    path: str
    fanout: int
    step: int
    passes: int

    def nodes(self, low: int, high: int) -> DataFrame:
        """The nodes of the levels from low to high, with their level."""
        schema = StructType.fromDDL(f"{NODE}, level int")
        return self.leaves.sparkSession.read.schema(schema).parquet(self.path).where(F.col("level").between(low, high))

    def tops(self) -> DataFrame:
        """(grp, top): the root of each group."""
        at_top = (F.col("pos") == 0) & (F.col("level") == height(F.col("n"), self.fanout))
        return self.nodes(0, 1 << 20).where(at_top).select("grp", "n", F.col("hash").alias("top"))

    def blocks(self, d: DataFrame, low: int) -> DataFrame:
        """``d`` (nodes of the levels from low on) with up (their level above
        low), tall (levels of their block that hold siblings) and block."""
        up, tall = F.col("level") - low, F.least(F.lit(self.step), height(F.col("n"), self.fanout) - low)
        block = F.coalesce(*[F.when(up == u, F.expr(f"pos div {self.fanout ** (self.step - u)}")) for u in range(self.step)])
        return d.withColumns({"up": up, "tall": tall, "block": block})


def build(leaves: DataFrame, order: list[str], fanout: int = 2, block: int = BLOCK) -> Tree:
    """The trees over ``leaves`` (grp, hash and more), in ``order`` within each
    grp. An empty table has no nodes."""
    path, step = new_path(leaves.sparkSession, "nodes"), levels_of(block, fanout)
    placed = positions(leaves, order)
    placed.select(*StructType.fromDDL(NODE).names).write.parquet(f"{path}/level=0")
    tallest = placed.agg(F.max(height(F.col("n"), fanout)).alias("h")).first()["h"] or 0
    tree = Tree(placed, path, fanout, step, -(-tallest // step))
    for low in range(0, tallest, step):
        level = tree.blocks(tree.nodes(low, low), low).where("tall > 0").groupBy("grp", "block")
        level.applyInArrow(_grow(low, fanout), f"{NODE}, level int").write.partitionBy("level").mode("append").parquet(path)
    return tree


def _grow(low: int, fanout: int):
    """What a pass adds above the nodes of a block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        grp, n, tall = (t.column(c)[0].as_py() for c in ("grp", "n", "tall"))
        hashes, first, out = t.column("hash").to_pylist(), t.column("pos")[0].as_py(), []
        for up in range(1, tall + 1):
            hashes, first = join_up(hashes, fanout), first // fanout
            out += [(grp, first + i, n, h, low + up) for i, h in enumerate(hashes)]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out), types)], ["grp", "pos", "n", "hash", "level"])

    return run


def proofs(tree: Tree, above: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(grp, pos, hash, root, top, proof, keep...) for every leaf. ``above``:
    (grp, root, top, proof), what stands above each group's root, one row each.

    A proof holds for each level, from the leaf up, the siblings before and
    after its node, in order: texts of hex digits, empty where there is none."""
    tall = height(F.col("n"), tree.fanout)
    seed = above.join(tree.tops().select("grp", "n"), "grp").withColumn("last", F.greatest(F.lit(0), F.ceil(tall / tree.step) - 1))
    upper = seed.select("grp", "last", F.lit(0).cast("long").alias("block"), "root", "top", "proof")
    scan = None
    for p in range(max(1, tree.passes) - 1, -1, -1):
        low, extra = p * tree.step, keep if p == 0 else ()
        stored = tree.nodes(low if p else 1, low + tree.step - 1).where((tall > low) | F.lit(p == 0))
        if p == 0:
            stored = tree.leaves.withColumn("level", F.lit(0)).unionByName(stored, allowMissingColumns=True)
        rows = tree.blocks(stored, low).select("grp", "block", "up", "tall", "pos", "hash", *extra)
        over = upper.where(F.col("last") == p).drop("last")
        if scan is not None:  # this pass's blocks end where the last one's nodes stand
            over = over.unionByName(scan.select("grp", F.col("pos").alias("block"), "root", "top", "proof"))
        schema = StructType.fromDDL(f"grp string, pos long, hash string, root string, top string, proof {PROOF}")
        for c in extra:
            schema = schema.add(c, rows.schema[c].dataType)
        scan = rows.groupBy("grp", "block").cogroup(over.groupBy("grp", "block")).applyInArrow(_descend(tree.fanout, extra), schema)
    return scan


def _descend(fanout: int, extra: tuple[str, ...]):
    """The proofs of a block's lowest nodes, from its levels and what is above."""

    def run(rows: pa.Table, over: pa.Table) -> pa.Table:
        ups, places, hashes = (rows.column(c).to_pylist() for c in ("up", "pos", "hash"))
        known = dict(zip(zip(ups, places), hashes))
        made: dict[tuple[int, int], dict[str, str]] = {}

        def siblings(up: int, at: int) -> dict[str, str]:
            if (up, at) not in made:
                first = at - at % fanout
                text = lambda low, high: "".join(known.get((up, q), "") for q in range(low, high))
                made[up, at] = {"before": text(first, at), "after": text(at + 1, first + fanout)}
            return made[up, at]

        own = rows.filter(pc.equal(rows.column("up"), 0))
        tall, rest = rows.column("tall")[0].as_py(), over.column("proof")[0].as_py()
        found = [[siblings(u, pos // fanout**u) for u in range(tall)] + rest for pos in own.column("pos").to_pylist()]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        same = [pa.array([over.column(c)[0].as_py()] * len(found), pa.string()) for c in ("root", "top")]
        columns = [*(own.column(c) for c in ("grp", "pos", "hash")), *same, pa.array(found, kind), *(own.column(c) for c in extra)]
        return pa.table(columns, ["grp", "pos", "hash", "root", "top", "proof", *extra])

    return run


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(
    docs: DataFrame, leaf: Column, group: Column, order: Column, keep: dict[str, Column] | None = None, fanout: int = 2, block: int = BLOCK
) -> DataFrame:
    """``keep``, leaf, subroot, root and proof of every row of ``docs``; names
    that are taken get underscores.

    Rows of one ``group`` (null is one) are the leaves of its tree, in
    ``order`` (nulls first; ties by leaf, so rows alike may change places).
    Runs of ``fanout`` nodes become one until one is left, the subroot; the
    subroots, by the bytes of their group's text with null first, become the
    root in the same way. A proof leads from a leaf through its subroot to the
    root (``fold``). Other columns of ``docs``, of any name, don't matter; an
    empty table gives no rows. Texts are read once, to be hashed; from then on
    there are only hashes.
    """
    kept = keep or {}
    names = free_names(["grp", "pos", "n", "hash", "root", "top", "proof", "level", "up", "tall", "block", "at", "run", "last"], ["order", *kept])
    hashed = docs.select(group_key(group).alias("grp"), leaf.alias("hash"), order.alias(names["order"]), *[c.alias(names[k]) for k, c in kept.items()])
    slim = written(hashed, "hashes")
    tree = build(slim, [names["order"], "hash"], fanout, block)
    drop(slim)
    groups = build(tree.tops().select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("hash")), ["name"], fanout, block)
    root = groups.tops().select("grp", F.col("top").alias("root"), "top", F.array().cast(PROOF).alias("proof"))
    above = proofs(groups, root, ("name",)).select(F.col("name").alias("grp"), "root", F.col("hash").alias("top"), "proof")
    found = proofs(tree, above, tuple(names[k] for k in kept))
    added = free_names(kept, ["leaf", "subroot", "root", "proof"])
    out = {"leaf": "hash", "subroot": "top", "root": "root", "proof": "proof"}
    return found.select(*[F.col(names[k]).alias(k) for k in kept], *[F.col(c).alias(added[k]) for k, c in out.items()])
