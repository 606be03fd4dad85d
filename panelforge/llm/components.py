"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import drop, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "components", scratch: list[str] | None = None) -> DataFrame:
    """links(a, b) to (node, root): root is the least node of the component. Nodes without links don't appear.

    Self-links and repeats are allowed, null ends are dropped. Each round is a grouped minimum and a join, its result
    a table in the shared folder that replaces the one before; the driver sees two numbers a round. The path of the last
    one is added to scratch.
    """
    spark, held = links.sparkSession, []
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, name, held)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every node keeps its own least neighbour, so that no tie to a smaller node is lost
        large = large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, name, new := [])
        after = _state(edges)
        drop(spark, held)
        held = new
        if after == before:
            break
        before = after
    if scratch is not None:
        scratch += held
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
