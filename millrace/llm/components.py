"""Connected components of an edge table by contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): label is the same within a component.

    Every round maps each vertex to its least neighbour (or itself), follows
    that map once more, relabels the edges and drops loops and repeats; the
    number of vertices that still have edges at least halves.  Every round is
    written to the shared folder.  Maps are written before they are joined, so
    that both sides of each join are plain exchanges and a hub's edges can be
    split over tasks.  Raises if ``max_rounds`` don't suffice.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = materialize(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("label")), "labels")
    for _ in range(max_rounds):
        if edges.isEmpty():
            discard(edges)
            return labels
        both = edges.union(edges.select("b", "a"))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "step")
        jump = step.select(F.col("a").alias("m"), F.col("m").alias("m2"))
        twice = materialize(step.join(jump, "m").select("a", F.col("m2").alias("m")), "jump")
        to = twice.select(F.col("a").alias("label"), "m")
        relabelled = materialize(labels.join(to, "label", "left").select("v", F.coalesce("m", "label").alias("label")), "labels")
        ends = edges.join(twice, "a").select(F.col("m").alias("x"), "b")
        ends = ends.join(twice.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        left = materialize(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(step, twice, labels, edges)
        edges, labels = left, relabelled
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
