"""Connected components of a link table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centsible.llm.frames import written, written_counted


def forest_roots(parents: DataFrame) -> DataFrame:
    """node, root of every node of a forest (node, parent; one parent per node and no cycles), roots included.

    Each round doubles the steps that a node has gone, so there are as many rounds as the logarithm of the depth. A
    round is one join of the nodes, which hold one row each.
    """
    steps, further = parents.select("node", F.col("parent").alias("root")), 1
    while further:
        ends = steps.select(F.col("node").alias("via"), F.col("root").alias("next"))
        moved = steps.join(ends, steps["root"] == ends["via"], "left")
        moved = moved.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        steps, (further,) = written_counted(moved, "roots", F.count_if("moved"))
        steps = steps.select("node", "root")
    return steps.union(steps.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    others = down.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.union(least.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with a link; the root is the smallest node of its component.

    Alternating large and small stars until every node hangs on its root. Both are a grouped minimum,
    combined before the shuffle, and a join with one row per node, so a node with very many links is no
    hot spot that adaptive execution could not split. Each round's links are a table in the shared folder, and
    whether they have changed is seen while they are written.
    """
    state = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    links, now = written_counted(_small_star(edges), "links", *state)
    seen = None
    while now != seen:
        seen = now
        links, now = written_counted(_small_star(_large_star(links)), "links", *state)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
