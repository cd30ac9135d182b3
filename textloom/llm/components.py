"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges`` holds ``a`` and ``b`` (long). Loops, repeated edges and both directions are allowed;
    rows with a null end are ignored. Returns ``node``, ``component``; nodes without an edge to
    another node have no row.

    Every round points each node at its smallest neighbour's smallest neighbour and replaces the
    edges by edges between those, so the nodes left at least halve. The minimum is a partial
    aggregate, which a node with very many edges does not slow down. Every round is written to
    shared storage.
    """
    a, b = F.col("a"), F.col("b")
    left = materialize(
        edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.unionAll(left.select(b.alias("a"), a.alias("b")))
        lowest = ends.groupBy(a.alias("node")).agg(F.min("b").alias("low"))
        lowest = lowest.select("node", F.least("node", "low").alias("low"))
        beyond = lowest.select(F.col("node").alias("low"), F.col("low").alias("component"))
        parents = materialize(lowest.join(beyond, "low").select("node", "component"), "parents")
        rounds.append(parents)
        of_a = parents.select(F.col("node").alias("a"), F.col("component").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("component").alias("pb"))
        pa, pb = F.col("pa"), F.col("pb")
        left = materialize(
            left.join(of_b, "b")
            .join(of_a, "a")
            .where(pa != pb)
            .select(F.least(pa, pb).alias("a"), F.greatest(pa, pb).alias("b"))
            .distinct(),
            "edges",
        )
    if not rounds:
        return left.select(a.alias("node"), b.alias("component"))
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("component"), F.col("component").alias("root"))
        found = earlier.join(later, "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")
        )
    return found
