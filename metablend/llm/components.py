"""Connected components of a link table by repeated contraction, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


SMALL = 50_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, comp`` for every node of ``links`` (a, b): comp is the smallest node it is connected with.

    Each round maps a node to its smallest neighbour (or itself) and contracts the links; a hub with very
    many links is reduced by a partial aggregation, and the joins have a splittable side.  Rounds go on
    until no link between different nodes is left.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = checkpointed(both.distinct())
    if edges.count() <= SMALL:
        edges = edges.coalesce(1)  # a few rows: no exchanges in the rounds below, the same results
    labels = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        # every node to its smallest neighbour or itself
        step = checkpointed(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
                            .select(F.col("a").alias("from"), "to"))
        # two steps at once: the target's own target is at least as small
        onward = step.select(F.col("from").alias("f2"), F.col("to").alias("to2"))
        step = checkpointed(step.join(onward, step["to"] == onward["f2"], "left")
                            .select("from", F.coalesce("to2", "to").alias("to")))
        if labels is None:
            labels = step.select(F.col("from").alias("node"), F.col("to").alias("comp"))
        else:
            labels = checkpointed(labels.join(step, labels["comp"] == step["from"], "left")
                                  .select("node", F.coalesce("to", "comp").alias("comp")))
        left, right = step.select(F.col("from").alias("fa"), F.col("to").alias("ta")), \
            step.select(F.col("from").alias("fb"), F.col("to").alias("tb"))
        edges = checkpointed(edges.join(left, edges["a"] == left["fa"]).join(right, edges["b"] == right["fb"])
                             .where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    if not edges.isEmpty():
        raise RuntimeError("components did not settle")
    return labels
