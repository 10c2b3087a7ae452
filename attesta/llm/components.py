"""Connected components by smallest label, with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import drop, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (src, dst): the smallest id
    that can be reached.

    A round takes the smallest label among a node's neighbours, lowers each
    label's own node to the smallest that any node of that label met, and then
    takes the label of the label; so chains fold up in few rounds in whatever
    order their ids stand. Rounds go on until no label moves, when neighbours
    all agree. Each round's labels are a table in the shared folder; none
    passes through the driver. No edges: no rows. Nodes joined only with
    themselves are their own component.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("src", "dst"), "edges")
    labels = written(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).withColumnRenamed("src", "id"), "labels")
    moved = True
    while moved:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("src", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        hook = step.groupBy("old").agg(F.min("label").alias("hook")).withColumnRenamed("old", "id")
        up = labels.join(hook, "id", "left").select(F.col("id").alias("label"), F.least("component", "hook").alias("above"))
        new = written(
            step.join(up, "label", "left").select(
                "id", F.least("label", "above").alias("component"), (F.least("label", "above") != F.col("old")).alias("moved")
            ),
            "labels"
        )
        drop(labels)
        labels = new.select("id", "component")
        moved = new.where("moved").limit(1).count() > 0
    drop(both)
    return labels
