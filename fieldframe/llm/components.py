"""Connected components of an edge table, as joins and aggregates on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): each node of edges (a, b) with the smallest node it can reach.

    Each round maps every node to the smallest of itself and its neighbours and rewires
    the edges to the images, so the edge table shrinks until none is left; a node's
    component follows its images. Minima are aggregated before the shuffle, so a node
    with very many edges costs one row a task. Null ends and loops count for nothing; no
    edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    image = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to"))
        low = written(low, "low")
        if image is None:
            image = low
        else:
            step = low.select(F.col("node").alias("to"), F.col("to").alias("next"))
            image = image.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        left = low.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = low.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = edges.join(left, "a").join(right, "b").where("a2 <> b2")
        edges = written(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return image.select("node", F.col("to").alias("component"))
