"""Connected components of an edge table by contraction, without gathering edges anywhere.

Each round every root hooks to its smallest neighbour if that is smaller, chains are shortened by pointer jumping, and the edges
are renamed to the roots; at least half of the roots that have edges vanish each round.  Every step is written to the shared
folder, so a lost executor repeats little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches."""
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).select("id", F.least("id", "up").alias("up")), "hook")
        while True:
            over = step.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = step.join(over, "up").select("id", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved"))
            jumped = written(jumped, "jump")
            step = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = step.select("id", F.col("up").alias("component"))
        else:
            labels = labels.join(step.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        root = lambda c: step.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        live = live.join(root("a"), "a").join(root("b"), "b").where("a_up <> b_up")
        live = written(live.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return written(labels, "components")
