"""Connected components by contraction of written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafac.llm.tables import written


def _normal(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``label`` (one node of its component) for every node of ``edges`` (x, y).

    Each round points every node to its smallest neighbour (or itself) and
    contracts the edges to these; a component of diameter d takes about
    log d rounds, stars two. Only the number of edges left reaches the driver.
    """
    edges = written(_normal(edges), f"{name}-edges")
    labels = None
    while True:
        if edges.isEmpty():
            break
        both = edges.union(edges.select("y", "x"))
        parents = written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("p")), f"{name}-parents")
        px = parents.select("x", F.col("p").alias("px"))
        py = parents.select(F.col("x").alias("y"), F.col("p").alias("py"))
        edges = written(_normal(edges.join(px, "x").join(py, "y").select(F.col("px").alias("x"), F.col("py").alias("y"))), f"{name}-edges")
        step = parents.select(F.col("x").alias("from"), F.col("p").alias("to"))
        if labels is None:
            labels = step.select(F.col("from").alias("node"), F.col("to").alias("label"))
        else:
            moved = labels.join(step, F.col("label") == F.col("from"), "left")
            labels = written(moved.select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")
    if labels is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return labels
