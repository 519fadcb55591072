"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """Return (vertex, component) for every vertex of edges (a long, b long); component is a vertex of its component.

    In each round a vertex points to its smallest neighbour if that is smaller than itself; pointers are followed to their end
    by doubling; the edges are then drawn between the ends, and loops and repeats go. So a chain of any length falls to one
    vertex in one round of as many doublings as the logarithm of its length. The neighbours of a vertex are never gathered:
    their minimum is summed up before the shuffle.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("vertex"), F.least("a", "least").alias("component"))
        step = settled(pointers).select(F.col("vertex").alias("old"), F.col("component").alias("new"))
        steps.append(step)
        at_a = step.select(F.col("old").alias("a"), F.col("new").alias("new_a"))
        at_b = step.select(F.col("old").alias("b"), F.col("new").alias("new_b"))
        moved = edges.join(at_a, "a").join(at_b, "b").filter("new_a <> new_b")
        edges = written(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("vertex"), F.col("a").alias("component"))
    found = steps[0].select(F.col("old").alias("vertex"), F.col("new").alias("component"))
    for step in steps[1:]:
        renamed = step.select(F.col("old").alias("component"), F.col("new").alias("next"))
        found = found.join(renamed, "component", "left").select("vertex", F.coalesce("next", "component").alias("component"))
    return found


def settled(parents: DataFrame) -> DataFrame:
    """Follow (vertex, component) until no component is itself a vertex with another component."""
    parents = written(parents)
    while True:
        up = parents.filter("vertex <> component").select(F.col("vertex").alias("component"), F.col("component").alias("next"))
        followed = parents.join(up, "component", "left").select("vertex", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved"))
        followed = written(followed)
        parents = followed.drop("moved")
        if followed.filter("moved").isEmpty():
            return parents
