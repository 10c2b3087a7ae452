"""Larsen inference, its index of rules, and the Mamdani centroid."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.scalars import rounded
from ..sources.shared import small, written

ACTIVE = ["active_rule", "expert_verified", "expert_verified_rule"]
#: Statuses and decisions are fixed values of the rule format.
REFUSED = ["pending", "reject", "rejected", "否", "不通过"]


def accepted_rules(rules: DataFrame) -> DataFrame:
    """Rules that no expert refused; no decision counts as accepted."""
    return rules.where(~F.lower(F.trim(F.coalesce("expert_decision", F.lit("accepted")))).isin(REFUSED))


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("review_status").isin(ACTIVE))


def best_memberships(m: DataFrame, seq: str = "seq") -> DataFrame:
    """The greatest membership of each source and variable, the first of
    equals, with its own interval. An aggregate, so it combines before the
    shuffle."""
    best = F.min(F.struct((-F.col("membership")).alias("neg"), F.col(seq).alias("at"), "p5", "p95"))
    return m.groupBy("source_id", "variable_key").agg(best.alias("b")).select(
        "source_id", "variable_key", (-F.col("b.neg")).alias("membership"), "b.p5", "b.p95"
    )


#: Bytes (as JSON) of rules that are broadcast at once; more go in several parts.
RULE_BYTES = 32 << 20
#: Blocks that a source meets one by one where it meets every rule.
BLOCKS = 8
#: Antecedents up to which a rule is worked out step by step in plain columns,
#: which the engine compiles; longer rules go by lambdas, which it interprets.
STEPS = 8


def by_source(best: DataFrame) -> DataFrame:
    """(source_id, m): the memberships of each source as a map by variable, of
    which there are no more than the lexicon has."""
    cell = F.struct("variable_key", F.struct("membership", "p5", "p95"))
    return best.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("variable_key").isNotNull(), cell))).alias("m"))


def slim_rules(rules: DataFrame) -> tuple[DataFrame, int, int | None, bool]:
    """The active rules as a table (uid, rule_id, consequent, weight, ants), the
    number of parts in which they are broadcast, the most antecedents of one of
    up to STEPS (None: there is none) and if there are longer ones, all that
    the driver sees."""
    ants = F.transform("antecedents", lambda a: F.struct(
        F.concat_ws(".", a["variable"].cast("string"), a["fuzzy_set"].cast("string")).alias("key"),
        F.coalesce(a["threshold"].cast("double"), F.lit(0.0)).alias("threshold"), F.coalesce(a["weight"].cast("double"), F.lit(1.0)).alias("weight")))
    text = [F.col(c).cast("string").alias(c) for c in ("rule_id", "consequent_entity", "consequent_type")]
    active = active_rules(rules).select(
        F.monotonically_increasing_id().alias("uid"), *text, F.col("rule_weight").cast("double").alias("rule_weight"), ants.alias("ants")
    )
    table = written(active, "active-rules")
    size, steps, longer = table.agg(
        F.sum(F.octet_length(F.to_json(F.struct("*")))), F.max(F.when(_short(), F.size("ants"))), F.count(F.when(~_short(), 1))
    ).first()
    return table, max(1, -(-(size or 0) // RULE_BYTES)), steps, longer > 0


def _short() -> Column:
    return F.coalesce(F.size("ants"), F.lit(-1)).between(0, STEPS)


def by_length(table: DataFrame, steps: int | None, longer: bool, rows: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """``rows`` of the rules of up to ``steps`` antecedents and of the longer
    ones (None), where there are any."""
    found = [] if steps is None else [rows(table.where(_short()) if longer else table, steps)]
    if longer or not found:
        found.append(rows(table.where(~_short()), None))
    return reduce(DataFrame.unionByName, found)


def met(sources: DataFrame, rules: DataFrame, parts: int, on: list[str]) -> DataFrame:
    """``sources`` joined with rules on ``on``, the rules broadcast part by
    part; so sources stay where they are and each broadcast has a bound."""
    part = F.pmod(F.xxhash64("uid"), F.lit(parts))
    return reduce(DataFrame.union, [sources.join(F.broadcast(rules.where(part == i)), on) for i in range(parts)])


class Antecedents:
    """What is asked of a row's antecedents ``ants``, each with what the source's
    memberships ``m`` say of it, in order: column by column for rules of up to
    ``steps`` (those after a rule's last are null and change nothing), by
    lambdas if that is None."""

    def __init__(self, steps: int | None):
        self.cells = None if steps is None else [self.cell(F.get("ants", F.lit(i))) for i in range(steps)]

    @staticmethod
    def cell(a: Column) -> dict[str, Column]:
        own = F.col("m")[a["key"]]
        mu = F.coalesce(own["membership"], F.lit(0.0))
        return {"key": a["key"], "threshold": a["threshold"], "weight": a["weight"], "mu": mu, "p5": own["p5"], "p95": own["p95"]}

    def seen(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what lambdas look at, so that they look up once."""
        if self.cells is not None:
            return rows
        return rows.withColumn("seen", F.transform("ants", lambda a: F.struct(*[c.alias(n) for n, c in self.cell(a).items()])))

    def enough(self) -> Column:
        test = lambda s: s["mu"] >= s["threshold"]
        if self.cells is None:
            return F.forall("ants", lambda a: test(self.cell(a)))
        return reduce(Column.__and__, [F.coalesce(test(s), F.lit(True)) for s in self.cells], F.lit(True))

    def some(self, test) -> Column:
        if self.cells is None:
            return F.exists("seen", test)
        return reduce(Column.__or__, [F.coalesce(test(s), F.lit(False)) for s in self.cells], F.lit(False))

    def product(self, of) -> Column:
        """The rule's weight times ``of`` each."""
        if self.cells is None:
            return F.aggregate("seen", F.col("rule_weight"), lambda x, s: x * of(s))
        return reduce(lambda x, s: x * F.coalesce(of(s), F.lit(1.0)), self.cells, F.col("rule_weight"))

    def keys(self, test) -> Column:
        if self.cells is None:
            return F.transform(F.filter("seen", test), lambda s: s["key"])
        none = F.array().cast("array<string>")
        return F.concat(none, *[F.when(test(s), F.array(s["key"])).otherwise(none) for s in self.cells])


def activated(rows: DataFrame, steps: int | None) -> DataFrame:
    """What the rule of each row (rule_weight, ants, ...) gives with the
    memberships ``m``."""
    each = Antecedents(steps)
    zero, one = F.lit(0.0), F.lit(1.0)

    def fold(of) -> Column:
        total = each.product(lambda s: F.pow(F.greatest(of(s), F.lit(1e-12)), s["weight"]))
        return F.round(F.greatest(zero, F.least(one, total)), 6)

    below = lambda s: s["mu"] < s["threshold"]
    ranged = each.some(lambda s: s["p5"].isNotNull() | s["p95"].isNotNull())
    return each.seen(rows).select(
        "source_id", "rule_id", "consequent_entity", "consequent_type", fold(lambda s: s["mu"]).alias("activation"),
        each.keys(lambda s: s["mu"] >= s["threshold"]).alias("supporting_variables"), each.keys(below).alias("missing_variables"),
        F.when(~each.some(below), "fired").otherwise("below_threshold").alias("status"),
        *[F.when(ranged, fold(lambda s, c=c: F.coalesce(s[c], s["mu"]))).alias(c) for c in ("p5", "p95")],
    )


def _all_with(sources: DataFrame, rules: DataFrame, parts: int) -> DataFrame:
    """Every source with every rule, as each such pair is a row of the result:
    rules stand in blocks, and a source meets block after block."""
    block = F.pmod(F.xxhash64("uid"), F.lit(BLOCKS)).cast("int")
    each = sources.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    return met(each, rules.withColumn("block", block), parts, ["block"])


def larsen(best: DataFrame, rules: DataFrame) -> DataFrame:
    """Activation of every active rule for every source with memberships: the
    rule's weight times the antecedents' memberships, each to the power of its
    weight, in order. Fired if no antecedent is below its threshold; a missing
    one counts as 0. The interval is that of the winning memberships and null
    where none has one.

    Rules are rows, any number of them: the plan is the same for one as for a
    million, and none passes through the driver.
    """
    table, parts, steps, longer = slim_rules(rules)
    tasks = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes of sources make many rows
    sources = by_source(best.repartition(tasks, "source_id"))
    return by_length(table, steps, longer, lambda some, n: activated(_all_with(sources, some, parts), n))


def fired(best: DataFrame, rules: DataFrame) -> DataFrame:
    """The fired rows of ``larsen`` by an index from variables to rules.

    Each rule that needs a membership (a threshold above 0) is filed under the
    needed variable that the fewest sources have, so a variable of a third of
    the sources brings up no rule that also needs a rarer one. A source meets
    the rules filed under its variables, if it reaches the threshold there, and
    those that need none; only then are all antecedents looked at. Rules that
    need a variable no source has can't fire and go first.
    """
    table, parts, steps, longer = slim_rules(rules)
    sources = written(by_source(best), "by-source")
    often = sources.select(F.explode(F.map_keys("m")).alias("key")).groupBy("key").agg(F.count("*").alias("often"))
    needs = table.select("uid", F.explode("ants").alias("a")).select("uid", "a.key", "a.threshold").where("threshold > 0")
    least = F.min_by(F.struct("key", "threshold"), F.struct("often", "key"))
    filed = needs.join(often, "key", "left").groupBy("uid").agg(least.alias("at"), F.count(F.when(F.col("often").isNull(), 1)).alias("never"))
    index = written(
        table.join(filed.where("never = 0"), "uid").select(table["*"], F.col("at.key").alias("key"), F.col("at.threshold").alias("least")),
        "rule-index"
    )
    own = sources.select("source_id", "m", F.explode("m").alias("key", "e")).select("source_id", "m", "key", F.col("e.membership").alias("mu"))
    free = table.join(needs.select("uid"), "uid", "left_anti")
    columns = ["source_id", "m", "rule_id", "consequent_entity", "consequent_type", "rule_weight", "ants"]

    def filed_rows(some: DataFrame, n: int | None) -> DataFrame:
        found = met(own, some, parts, ["key"]).where((F.col("mu") >= F.col("least")) & Antecedents(n).enough())
        return activated(found.select(*columns), n)

    def free_rows(some: DataFrame, n: int | None) -> DataFrame:
        return activated(_all_with(sources, some, parts).where(Antecedents(n).enough()).select(*columns), n)

    return by_length(index, steps, longer, filed_rows).unionByName(by_length(free, steps, longer, free_rows))


def shapes_of(rules: DataFrame, shapes: dict[str, list[float]], default: tuple[float, ...] = (0.45, 0.70, 1.0, 1.0)) -> DataFrame:
    """(rule_id, a, b, c, d): each rule's shape by its consequent, else by the
    consequent's type, else that named default, else ``default``."""
    named = [(k, *map(float, v)) for k, v in shapes.items()]
    table = rules.sparkSession.createDataFrame(named, "name string, a double, b double, c double, d double")
    out = rules.select("rule_id", "consequent_entity", "consequent_type")
    for i, name in enumerate((F.col("consequent_entity"), F.col("consequent_type"), F.lit("default"))):
        own = table.select(F.col("name").alias(f"n{i}"), F.struct("a", "b", "c", "d").alias(f"s{i}"))
        out = out.join(small(own), name == F.col(f"n{i}"), "left")
    found = F.coalesce("s0", "s1", "s2", F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("abcd", default)]))
    return out.select("rule_id", found.alias("s")).select("rule_id", "s.*")


def mamdani(fired: DataFrame, shapes: DataFrame, points: int = 200) -> DataFrame:
    """Centroid, area and greatest height of the union of the rules' shapes,
    each cut at its activation, for every source and consequent. ``shapes``:
    (rule_id, a, b, c, d), as small as the rules; rules without one are left
    out. Rows of one source and consequent are all that meets; a task takes
    the heights of a batch of them step by step."""
    cuts = fired.join(small(shapes), "rule_id").groupBy("source_id", "consequent_entity").agg(
        F.sort_array(F.collect_list(F.struct("rule_id", "activation", "a", "b", "c", "d"))).alias("cuts")
    )
    out = StructType([cuts.schema["source_id"], cuts.schema["consequent_entity"]]).add("centroid", "double").add("area", "double")
    out = out.add("max_membership", "double").add("rules", ArrayType(shapes.schema["rule_id"].dataType))
    g = cuts.mapInArrow(lambda batches: (_union(b, points) for b in batches), out)
    return g.select(
        "source_id", "consequent_entity", *[rounded(F.col(c)).alias(c) for c in ("centroid", "area", "max_membership")], "rules",
        F.lit("mamdani_centroid_sensitivity").alias("mode")
    )


def _union(b: pa.RecordBatch, points: int) -> pa.RecordBatch:
    """Centroid, area and greatest height of each row's cuts: all rows' heights
    at one step after the other, so memory is that of the cuts."""
    cells = b.column("cuts").flatten()
    first = np.cumsum([0, *b.column("cuts").value_lengths().to_pylist()])[:-1]
    activation, p, q, r, s = [np.asarray(cells.field(c).cast(pa.float64())) for c in ("activation", "a", "b", "c", "d")]
    total, moment, most = np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows)
    before = None
    for i in range(points if b.num_rows else 0):
        x = i / (points - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where(x < q, (x - p) / (q - p), (s - x) / (s - r))
        y = np.where((x < p) | (x > s), 0.0, np.where((x >= q) & (x <= r), 1.0, y))
        y = np.maximum.reduceat(np.minimum(activation, y), first)
        if before is not None:
            x0, y0 = before
            total, moment = total + (y0 + y) / 2 * (x - x0), moment + (x0 * y0 + x * y) / 2 * (x - x0)
        most, before = np.maximum(most, y), (x, y)
    centroid = np.divide(moment, total, out=np.zeros(b.num_rows), where=total > 0)
    cells = [pa.array(v, pa.float64()) for v in (centroid, total, most)]
    rules = pa.ListArray.from_arrays(b.column("cuts").offsets, b.column("cuts").values.field("rule_id"))
    return pa.RecordBatch.from_arrays([b.column("source_id"), b.column("consequent_entity"), *cells, rules], ["source_id", "consequent_entity", "centroid", "area", "max_membership", "rules"])


def last_of(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("__n = 1").drop("__n")
