"""N-gram Jaccard join with signature trees.

The upper levels of the tree are cut by content, so that they can be spread:
documents of near sizes divide the space of shingle hashes into so many ranges
that two sets which differ in no more places than the threshold allows must
agree in several ranges whole. As they agree in r of them, they also agree in
one that is not among the r - 1 most frequent ones of either; so passages that
many documents share bring nothing together unless they fill most of a
document. Node pairs that agree in no range left can't overlap enough and are
never met. What meets becomes blocks; over each block stands a tree
whose nodes hold OR-combined bitmaps of shingles and size ranges, and a dual
traversal prunes node pairs by their largest possible overlap. The leaves'
pairs are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .hashing import U, batches, mix, shingle_sets
from .storage import drop, written

#: Documents and shingles that a block aims at.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4 << 20
FANOUT = 16
#: Clusters beyond a block whose sets would be sent more than FEW times each are
#: gone through by stars first, in at most so many ROUNDS.
FEW, ROUNDS = 8, 1
_classes = [1, 2, 3, 5]


def _class(n: int) -> int:
    """Size class: each one's sizes run up to half as much again."""
    while _classes[-1] <= n:
        _classes.append(-(-_classes[-1] * 3 // 2))
    return int(np.searchsorted(_classes, n, "right")) - 1


def plan(c: int, percent: int) -> tuple[int, int, int]:
    """For sets of size class c or the one below: ranges, how many of them may
    be empty without counting, and in how many that count two linked sets
    agree at least.

    Sets a, b of Jaccard similarity t = percent / 100 or more differ in at
    most (1 - t) / (1 + t) * (a + b) places, each of which spoils one range.
    """
    _class(_classes[c] * 2)
    places = (100 - percent) * 2 * (_classes[c + 1] - 1) // (100 + percent)
    spare, agree = (places + 1) // 16, 1 + places // 4
    return places + spare + agree, spare, agree


def range_signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a sorted set in each range of the hash space;
    the lowest byte is the size class.

    Ranges empty in both sets don't count: some are spare for those, and a set
    with more empty ranges than spare ones also emits its empty ones, as must
    its partner. A set near its class's upper end also emits the ranges of the
    next class, whose members it may match.
    """
    n, out = len(s), []
    k = _class(n)
    for c in (k, k + 1) if 100 * n >= percent * _classes[k + 1] else (k,):
        m, spare, _ = plan(c, percent)
        part = ((s >> U(32)) * U(m) >> U(32)).astype(np.int64)
        sums = np.zeros(m, U)
        np.add.at(sums, part, mix(s))
        filled = np.bincount(part, minlength=m) > 0
        at = np.arange(m)
        if m - filled.sum() <= spare:
            at = at[filled]
        sig = mix(sums[at] + at.astype(U) * U(0x9E3779B97F4A7C15) + U((c + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
        out.append(sig & U(2**64 - 256) | U(c))
    return np.concatenate(out)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U), mix(s + U(0x5DEECE66D)).sum(dtype=U)
    return int(np.int64(a)), int(np.int64(b))


class Tree:
    """Levels of nodes over documents sorted so that like ones are near. A
    node covers documents lo to hi; it holds the OR of their bitmaps, their
    least and greatest size and the most shingles that share bits in one."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        size = np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), bits // 64), U)
        for row, s in zip(maps, sets):
            at = (s & U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, U(1) << (at & 63).astype(U))
        spare = size - np.bitwise_count(maps).sum(1)
        # levels[0]: one node per document
        self.levels = [(np.arange(len(sets)), np.arange(len(sets)) + 1, maps, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            lo, hi, m, least, most, sp = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            ends = np.minimum(at + FANOUT, len(lo)) - 1
            self.levels.append(
                (
                    lo[at], hi[ends], np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at),
                    np.maximum.reduceat(sp, at)
                )
            )


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes i of level a and j of level b may hold a link, by the
    largest possible overlap of their bitmaps and by their sizes."""
    most = np.minimum(a[4][i], b[4][j])
    common = np.bitwise_count(a[2][i] & b[2][j]).sum(-1) + np.minimum(a[5][i], b[5][j])
    bound = np.minimum(most, common)
    return bound * (100 + percent) >= percent * (a[3][i] + b[3][j])


def traverse(left: Tree, right: Tree, group: np.ndarray, shift: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the documents' components (``group``: a label for each
    document of left and, from ``shift`` on, right; updated). Pairs that are
    in one component already are left out, as they change nothing."""
    links = []
    own = left is right
    top = (len(left.levels) - 1, len(right.levels) - 1)
    stack = [(top[0], 0, top[1], 0)]
    while stack:
        la, p, lb, q = stack.pop()
        a, b = left.levels[la], right.levels[lb]
        ga, gb = group[a[0][p] : a[1][p]], group[shift + b[0][q] : shift + b[1][q]]
        if ga[0] == gb[0] and not la == lb == 0 and (ga == ga[0]).all() and (gb == ga[0]).all():
            continue
        down_a, down_b = max(la - 1, 0), max(lb - 1, 0)
        i = np.arange(p * FANOUT, min((p + 1) * FANOUT, len(left.levels[down_a][0]))) if la else np.array([p])
        j = np.arange(q * FANOUT, min((q + 1) * FANOUT, len(right.levels[down_b][0]))) if lb else np.array([q])
        i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        if own and down_a == down_b:
            keep = i <= j if down_a else i < j
            i, j = i[keep], j[keep]
        ok = may_link(left.levels[down_a], i, right.levels[down_b], j, percent)
        i, j = i[ok], j[ok]
        if down_a or down_b:
            stack += [(down_a, x, down_b, y) for x, y in zip(i.tolist(), j.tolist())]
            continue
        for x, y in zip(i.tolist(), j.tolist()):
            gx, gy = group[x], group[shift + y]
            if gx == gy:
                continue
            s, t = left.sets[x], right.sets[y]
            both = len(s) + len(t)
            at = np.searchsorted(t, s)
            inter = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            if 100 * inter >= percent * (both - inter):
                group[group == max(gx, gy)] = min(gx, gy)
                links.append((x, y))
    return links


def block_links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets of a block: among all (side 0 everywhere) or
    between sides 0 and 1. Documents are sorted by their least shingles."""
    out = []
    order = sorted(range(len(ids)), key=lambda r: (side[r], sets[r][: 1].tolist(), len(sets[r]), ids[r]))
    ids, side, sets = ids[order], side[order], [sets[r] for r in order]
    n = int((side == 0).sum())
    group = np.arange(len(ids))
    middle = np.median([len(s) for s in sets])
    bits = int(min(1 << 16, max(256, 1 << int(np.ceil(np.log2(4 * middle))))))
    if n == len(ids):
        tree = Tree(sets, bits)
        found = traverse(tree, tree, group, 0, percent)
        shift = 0
    elif n == 0:
        return out
    else:
        found, shift = traverse(Tree(sets[:n], bits), Tree(sets[n:], bits), group, n, percent), n
    return [(int(ids[x]), int(ids[shift + y])) for x, y in found]


def shingle_table(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits of the set)."""

    def run(it):
        for b in it:
            ids = b.column(0)
            for first, texts in batches(b.column(1)):
                sets = shingle_sets(texts, n)
                hashes = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64())
                    ],
                    ["doc_id", "n_shingles", "h1", "h2"],
                )

    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def range_table(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """sig, h1: the ranges of every set. They are many times what a set's own
    row holds, so they are hashed anew from the texts rather than stored. Of
    copies in one run of a batch one is enough."""

    def run(it):
        for b in it:
            for _, texts in batches(b.column(0)):
                found = {set_hash(s)[0]: s for s in shingle_sets(texts, n) if len(s)}
                if found:
                    sigs = [range_signatures(s, percent) for s in found.values()]
                    h1 = np.repeat(np.fromiter(found, np.int64, len(found)), [len(x) for x in sigs])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(h1)], ["sig", "h1"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sig long, h1 long")


def candidate_edges(ranges: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst): sets (by h1) that agree in a range, each with the smallest
    of its range; and the ranges (sig, h1) by which they do. Of the ranges of a set that others share, the most frequent
    ones are left out, one fewer than linked sets agree in; the order is one
    for all sets, so linked ones still meet. One shuffle by range, over
    which a window counts: a set has as many ranges as its size asks for, so
    even one range of a third of all sets is a small share of the rows, and a
    window spills. A set's smallest ones (no more than its ranges)
    are joined with the least of them, which leaves the components as they are
    and most edges equal."""
    each = Window.partitionBy("sig")
    counted = ranges.select("sig", "h1", F.count("*").over(each).alias("often"), F.min("h1").over(each).alias("least"), F.max("h1").over(each).alias("most"))
    met = counted.where("least != most").select("sig", "h1", "often").distinct()
    agree = F.array(*[F.lit(plan(c, percent)[2]) for c in range(64)])
    place = F.row_number().over(Window.partitionBy("h1", "class").orderBy(F.desc("often"), "sig"))
    left = written(
        met.withColumn(
            "class", F.col("sig").bitwiseAND(255).cast("int")
        ).withColumn("place", place).where(F.col("place") >= agree[F.col("class")]).select("sig", "h1"),
        "ranges"
    )
    meet = left.groupBy("sig").agg(F.min("h1").alias("dst"), F.max("h1").alias("most")).where("dst != most").select("sig", "dst")
    found = left.join(meet, "sig").where("h1 != dst").select(F.col("h1").alias("src"), "dst").distinct()
    least = found.withColumn("least", F.min("dst").over(Window.partitionBy("src")))
    return least.select("src", F.col("least").alias("dst")).union(
        least.where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    ).distinct(), left


def star_links(
    members: DataFrame, shared: DataFrame, verify: Callable[[DataFrame, list[str]], DataFrame], block_docs: int, block_shingles: int
) -> tuple[DataFrame | None, DataFrame]:
    """Links of clusters beyond a block that are found by comparing each set
    with one other: of the ranges it is in (``shared``: sig, h1), each names a
    centre, and the set meets one that isn't linked with it yet. So a round
    sends each text once, and a centre's once for each block of its star; near
    copies mostly fall together in the first. Returns the links, if any, and
    (h1, label): the component that each set is in by them."""
    labels, links = members.select("h1", F.col("rep").alias("label")), None
    for turn in range(ROUNDS):
        own = shared.join(labels, "h1")
        centre = F.min_by(F.struct("h1", "label"), F.xxhash64("h1", F.lit(turn))).alias("centre")
        named = own.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), centre).where("lo <> hi").select("sig", "centre")
        pairs = own.join(named, "sig").where(F.col("label") != F.col("centre.label")).groupBy("h1").agg(F.min("centre.h1").alias("block"))
        leaves = members.drop("unit").join(pairs, "h1")
        parts = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts")
        stars = written(leaves.groupBy("block").agg(parts), "stars")
        leaves = leaves.join(stars, "block").withColumn("part", F.pmod(F.xxhash64("h2", "rep"), F.col("parts")).cast("int"))
        centres = members.drop("unit").join(stars, F.col("h1") == F.col("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        columns = ["rep", "h1", "h2", "block", "part"]
        rows = leaves.select(*columns, F.lit(1).alias("side")).unionByName(centres.select(*columns, F.lit(0).alias("side")))
        found = written(verify(rows, ["block", "part"]), "links")
        drop(stars)
        if not found.limit(1).count():
            break
        links = found if links is None else links.union(found)
        comp = connected_components(links)
        labels = members.select("h1", "rep").join(comp, F.col("rep") == F.col("id"), "left").select("h1", F.coalesce("component", "rep").alias("label"))
    return links, labels


def open_ranges(shared: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(h1, range): by which of the ranges that they share (``shared``: sig,
    h1) sets may still link with one of another label; without ``labels`` each
    set has its own. Of ranges that hold the same sets one is enough."""
    own = shared.withColumn("label", F.col("h1")) if labels is None else shared.join(labels, "h1")
    same = own.groupBy("sig").agg(
        F.count("*").alias("k"), F.bit_xor(F.xxhash64("h1")).alias("x"), F.min("h1").alias("lo"), F.max("h1").alias("hi"),
        F.min("label").alias("first"), F.max("label").alias("last"),
    ).where("first <> last")
    units = same.groupBy("k", "x", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig")
    return written(own.join(units, "sig").select("h1", F.col("sig").alias("range")), "open")


def rows_of(members: DataFrame, each: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """(unit, docs, rows, whole): how many rows each cluster takes range by
    range, and how many part by part."""
    parts = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles))
    weight = members.groupBy("unit").agg(F.count("*").alias("docs"), (2 * F.count("*") * parts).alias("whole"))
    rows = members.join(each.groupBy("h1").agg(F.count("*").alias("k")), "h1").groupBy("unit").agg(F.sum("k").alias("rows"))
    return written(weight.join(rows, "unit"), "weight")


def units_of(members: DataFrame, each: DataFrame, weight: DataFrame) -> DataFrame:
    """``members`` (of clusters beyond a block) that must still meet, by
    ``unit``: a range, or all of a cluster where that takes fewer rows."""
    m = members.join(weight.select("unit", (F.col("rows") > F.col("whole")).alias("by_parts")), "unit")
    ranged = m.where("NOT by_parts").drop("unit", "by_parts").join(each, "h1").withColumnRenamed("range", "unit")
    whole = m.where("by_parts").drop("by_parts").join(each.select("h1"), "h1", "left_semi")
    return whole.unionByName(ranged)


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links
    reach, its own included) of every row.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lowered; a document's set
    is its distinct n-word shingles, of fewer words all of them as one.
    Two link when 100 * intersection >= percent * union. Null and empty texts
    have no set and link with nothing. Rows that repeat an id are one document
    in the graph that links by any of its texts. Null ids have no place in it:
    their component_id is null. Other columns of any name go; an empty table
    gives no rows. Texts count as a whole, however long: a task holds those of
    two parts of a block.

    Every link is found (shingles are compared by 64 bits of hash); equal sets
    are one node. Candidates are verified cluster by cluster; a cluster beyond
    a block by the ranges that its sets share or part by part, whichever sends
    fewer rows. Where that would still be FEW times its sets or more, as of
    near copies, each set first meets one other (``star_links``), and then only
    sets that are still apart meet. A unit beyond a block is cut into bands of
    sizes that may link, and a band beyond a block into parts by hash, each
    pair of which is a block, so no task holds more than two parts. Candidate clusters and components are tables in the shared
    folder.
    """
    if not 70 <= percent <= 100:
        raise ValueError("similarities of 70 to 100 percent only")
    table = written(shingle_table(docs, id_col, text_col, n), "shingles")
    filled = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    edges, ranges = candidate_edges(range_table(docs, id_col, text_col, n, percent), percent)
    cluster = connected_components(edges).select(F.col("id").alias("h1"), F.col("component").alias("unit"))
    members = written(sets.join(cluster, "h1"), "clusters")

    def weigh(d: DataFrame) -> DataFrame:
        w = d.groupBy("unit").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
        return w.withColumn("big", (F.col("docs") > block_docs) | (F.col("shingles") > block_shingles))

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))

    def links(t: pa.Table) -> pa.Table:
        # the text that made the set, where an id has several; each once
        ids, sides, kept, seen = [], [], [], set()
        rep, side, h1, h2 = (t.column(c).to_pylist() for c in ("rep", "side", "h1", "h2"))
        for first, texts_ in batches(t.column("text")):
            for r, s in enumerate(shingle_sets(texts_, n), first):
                if (h1[r], h2[r]) not in seen and set_hash(s) == (h1[r], h2[r]):
                    seen.add((h1[r], h2[r]))
                    ids.append(rep[r])
                    sides.append(side[r])
                    kept.append(s)
        found = block_links(np.array(ids, np.int64), np.array(sides, np.int64), kept, percent) if ids else []
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["src", "dst"])

    def verify(rows: DataFrame, keys: list[str]) -> DataFrame:
        # members grow with the table: never broadcast them; and as many tasks as the session
        # asks for: the work is in the sets, not in the bytes by which tasks are merged
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.hint("merge").join(texts, "rep").repartition(tasks, *keys).groupBy(*keys).applyInArrow(links, "src long, dst long")

    grown = written(weigh(members).where("big").select("unit"), "grown")
    chained = grown.limit(1).count() > 0
    early = None
    if chained:
        big = written(members.join(grown, "unit", "left_semi"), "big")
        shared = written(ranges.join(big.select("h1"), "h1", "left_semi"), "shared")
        each = open_ranges(shared)
        weight = rows_of(big, each, block_docs, block_shingles)
        often = F.least("rows", "whole") > FEW * F.col("docs")
        apart = units_of(big, each, weight.where(~often))
        costly = weight.where(often).select("unit")
        if costly.limit(1).count():
            stars = written(big.join(costly, "unit", "left_semi"), "costly")
            own = written(shared.join(stars.select("h1"), "h1", "left_semi"), "shared")
            early, labels = star_links(stars, own, verify, block_docs, block_shingles)
            still = open_ranges(own, labels)
            apart = apart.unionByName(units_of(stars, still, rows_of(stars, still, block_docs, block_shingles)))
        units = written(members.join(grown, "unit", "left_anti").unionByName(apart), "units")
        for done in (members, big, shared):
            drop(done)
        members = units
    weight = weigh(members)
    total = weight.agg(F.sum("docs").alias("d"), F.sum("shingles").alias("s")).first()
    blocks = max(1, -(-(total["d"] or 0) // block_docs), -(-(total["s"] or 0) // block_shingles))
    m = members.join(weight.select("unit", "big"), "unit")
    # sets of two sizes can only link within one band of sizes or two neighbours
    band = F.floor(F.log("n") / (np.log(100 / percent) * 1.001))
    m = m.withColumn("band", F.explode(F.when(F.col("big"), F.array(band, band + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    m = m.withColumn("block", F.when(F.col("big"), F.col("unit")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(blocks))))
    m = m.select("rep", "h1", "h2", "n", "big", "block", "band")
    m = m.distinct() if chained else m  # a set may come by several ranges
    size = m.where("big").groupBy("block", "band").agg(
        F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts")
    )
    m = m.join(size.withColumn("big", F.lit(True)), ["big", "block", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("h2", "rep"), F.col("parts")).cast("int")
    m = m.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select(
        "rep", "h1", "h2", "big", "block", "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side")
    )
    linked = verify(m, ["big", "block", "band", "i", "j"])
    repeated = filled.join(sets, ["h1", "h2"]).select("doc_id", F.col("rep").alias("src")).where("doc_id != src").select(
        F.col("doc_id").alias("src"), F.col("src").alias("dst")
    )
    comp = connected_components(reduce(DataFrame.union, [linked, repeated, *([early] if early is not None else [])]))
    drop(members)
    drop(ranges)
    return table.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
