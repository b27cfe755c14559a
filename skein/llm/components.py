"""Connected components of a table of edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) to (id, component): for every end of an edge the smallest id that links reach.

    Each round takes the smallest label of the neighbours (summed before the shuffle, so that a hub with
    many neighbours costs one row a task), then the label of that label. Paths shrink geometrically; every
    round is written to the shared folder. Null ends are dropped; an empty table gives an empty one.
    """
    both = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    both = saved(both.select("src", "dst").union(both.select("dst", "src")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")), "labels")
    for _ in range(ROUNDS):
        near = (
            both.join(labels.withColumnRenamed("id", "dst"), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        moved = labels.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("jump"))
        moved = saved(moved.join(jump, "new", "left").select("id", F.least("new", "jump").alias("component"), (F.least("new", "jump") < F.col("component")).alias("moved")), "labels")
        labels = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
