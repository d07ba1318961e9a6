"""Recursion over a table, as a semi-naive fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int | None = None) -> DataFrame:
    """``node, steps``: every node that edges (``a`` to ``b``) lead to from a start (``node``), and by how few.

    Each round joins only the nodes found in the round before with the edges, and
    keeps what no round has found, so cycles end by themselves and no path is followed
    twice. A round's nodes are written to the shared folder. Relations over
    a common member (people of one group, say) are best given as edges to the member
    and back: then a large group is no more than its rows, not their pairs.

    Null nodes are none; edges and starts may repeat.
    """
    edges = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    frontier = cut(starts.where("node IS NOT NULL").select("node").distinct())
    found, steps = frontier.withColumn("steps", F.lit(0)), 0
    while (most_steps is None or steps < most_steps) and not frontier.isEmpty():
        steps += 1
        after = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = cut(after.join(found.select("node"), "node", "left_anti"))
        found = found.union(frontier.withColumn("steps", F.lit(steps)))
    return found
