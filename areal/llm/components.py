"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal.llm.common import dropped, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for every node of edges (a, b); any type with an order.

    Each round hooks every node to its smallest neighbour, shortens the chains, and contracts the edges; each contracted
    graph has at most half as many nodes, so rounds grow with the logarithm of the nodes. Partial minima are taken before
    a hub's neighbours are shuffled. In the joins that follow, one side has a single row for each node; where many nodes have one
    parent, adaptive execution splits the other side. Edges with a null end are ignored.
    """
    graph = written(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct()
    of = written(nodes.select("node", F.col("node").alias("component")), "component")
    for _ in range(most_rounds):
        if graph.isEmpty():
            dropped(graph)
            return of
        both = graph.union(graph.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        hook = hook_of = written(hook, "hook")
        for _ in range(2):  # grandparents, twice
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            hook = hook.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
        first, hook = hook_of, written(hook, "hook")
        a, b = (hook.select(F.col("node").alias(x), F.col("parent").alias(f"{x}2")) for x in "ab")
        moved = graph.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        before, graph = graph, written(moved.where("a <> b").distinct(), "edges")
        step = hook.select(F.col("node").alias("component"), F.col("parent").alias("next"))
        last, of = of, written(of.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "component")
        dropped(first, hook, before, last)
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")
