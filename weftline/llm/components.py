"""Connected components of a graph whose edges are a table: hooking to least neighbours and contraction, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import kept


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the least id that can be reached.

    In a round every vertex points to its least neighbour if that is less than
    itself, pointers are followed to their ends by doubling, and edges move to
    these ends; edges within one vertex go. Only the edges that are left take
    part in the next round, so the first round does nearly all of the work. A
    vertex with many neighbours is met by a partial aggregate only.
    """
    left = kept(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "cc-edges")
    labels = None
    while not left.isEmpty():
        down = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        roots = left.select(F.col("a").alias("id"), F.col("a").alias("parent"))
        pointers = kept(down.union(roots).groupBy("id").agg(F.min("parent").alias("parent")), "cc-pointers")
        while True:
            up = pointers.select(F.col("id").alias("parent"), F.col("parent").alias("far"))
            stepped = kept(pointers.join(up, "parent").select("id", "parent", "far"), "cc-pointers")
            pointers = stepped.select("id", F.col("far").alias("parent"))
            if stepped.where("parent <> far").isEmpty():
                break
        if labels is None:
            labels = pointers.select("id", F.col("parent").alias("component"))
        else:
            moved = pointers.select(F.col("id").alias("component"), F.col("parent").alias("to"))
            labels = kept(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "cc-labels")
        ends = pointers.select(F.col("id").alias("a"), F.col("parent").alias("to_a")), pointers.select(F.col("id").alias("b"), F.col("parent").alias("to_b"))
        moved = left.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        left = kept(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-edges")
    return labels if labels is not None else left.select(F.col("a").alias("id"), F.col("b").alias("component"))
