"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import saved


def _pointers(edges: DataFrame) -> DataFrame:
    """Every node with the smallest node of its closed neighbourhood."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select("b", "a")
    )
    return both.groupBy("node").agg(F.min(F.least("node", "other")).alias("parent"))


def _to_roots(pointers: DataFrame) -> DataFrame:
    """Follow the pointers to their ends, doubling the distance in each step."""
    while True:
        target = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        stepped = saved(
            pointers.join(target, "parent").select(
                "node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")
            ),
            "pointers",
        )
        pointers = stepped.select("node", "parent")
        if stepped.where("moved").isEmpty():
            return pointers


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges``, columns ``a`` and ``b``, of one
    comparable type without nulls; the component is its smallest node.

    Each round every node points at the smallest node near it, the pointers are
    followed to their roots, and the edges are drawn between roots. A node that is no
    root merges with another, so the roots of a component at least halve: rounds and
    steps are logarithmic. All state is written to the shared folder; the driver sees
    only whether anything is left. Aggregations combine before their shuffle and the
    joins can be split by adaptive execution, so a node with very many edges is no
    bottleneck. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    edges = saved(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        roots = _to_roots(_pointers(edges))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("component"))
        else:
            onward = roots.select(F.col("node").alias("component"), F.col("parent").alias("next"))
            labels = labels.join(onward, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")
            )
        labels = saved(labels, "labels")
        one = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        two = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        edges = saved(
            edges.join(one, "a")
            .join(two, "b")
            .where(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if labels is None:
        return loops.select("node", F.col("node").alias("component"))
    alone = loops.join(labels, "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("component")))
