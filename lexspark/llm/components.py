"""Connected components of a graph whose edges stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.store import saved


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour is hung on the smallest one of its node; a hot node is split by the join."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    joined = edges.join(least, "a")
    if larger_only:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
        least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node it reaches.

    ``edges`` has two columns of one ordered type, in any direction and with repeats. Large and small
    stars alternate until nothing changes, which takes about log(nodes) rounds. Each round is written
    to the shared folder; only two numbers a round come to the driver. Null ends are left out.
    """
    x, y = (F.col(c) for c in edges.columns)
    current = saved(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
                    .filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), name)
    before = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, larger_only=True).filter("a != b").distinct()
        small = _stars(large, larger_only=False).filter("a != b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        current = saved(small, name)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select("b", "b").distinct().toDF("node", "root"))
