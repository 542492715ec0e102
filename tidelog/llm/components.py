"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, stored

#: Rows of the edge and label tables for a file, so that small tables aren't many files.
FILE_ROWS = 1_000_000


def roots(took: DataFrame, files: int, paths: list[str]) -> DataFrame:
    """(node, took) followed to the end: pointers are doubled until none moves."""
    while True:
        onward = took.select(F.col("node").alias("at"), F.col("took").alias("next"))
        jumped = took.join(onward, F.col("took") == F.col("at"), "left").select("node", F.coalesce("next", "took").alias("took"), (F.col("next") < F.col("took")).alias("moved"))
        jumped = stored(jumped.coalesce(files), "pointers", paths)
        took = jumped.select("node", "took")
        if not jumped.filter("moved").take(1):
            return took


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for edges (a, b), a written table.

    Rounds of contraction: every node takes the least node next to it, pointers
    are followed to their ends, ends of edges are replaced by those, loops and
    repeats go.  What is left of a component after a round are nodes that were
    less than all their neighbours, half of it at most, so rounds and doublings
    grow with the logarithm of the size.  Each table is written in the shared
    folder, and deleted a round later; the driver sees the number of edges only.
    Minima are combined before their shuffles, so a node with very many edges
    isn't gathered in a task.
    """
    edges = edges.filter("a <> b").select("a", "b")
    before: list[str] = []
    labels = None
    while True:
        paths: list[str] = []
        files = 1 + 2 * edges.count() // FILE_ROWS
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("took"))
        took = roots(stored(least.coalesce(files), "took", paths), files, paths)
        if labels is None:
            kept = files
            labels = took.select("node", F.col("took").alias("label"))
        else:
            onward = took.select(F.col("node").alias("was"), "took")
            labels = stored(labels.join(onward, F.col("label") == F.col("was"), "left").select("node", F.coalesce("took", "label").alias("label")).coalesce(kept), "labels", paths)
        end_a = took.select(F.col("node").alias("a"), F.col("took").alias("to_a"))
        end_b = took.select(F.col("node").alias("b"), F.col("took").alias("to_b"))
        moved = edges.join(end_a, "a").join(end_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = stored(moved.filter("a <> b").distinct().coalesce(files), "edges", paths)
        discard(edges.sparkSession, before)
        before = paths
        if not edges.take(1):
            return labels
