"""Connected components of a graph that no machine holds in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import split_join, staged


#: Edges of so many (16 bytes each) may meet in one task; to look for heavy nodes among them costs more than it spares.
SMALL_EDGES = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b), both longs; root is the smallest node that paths reach.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each hangs neighbours from the smallest one known,
    by an aggregation and a join, until nothing changes. The edges of each round are written to the shared folder. In
    graphs of more than SMALL_EDGES, nodes of very many neighbours are joined apart, so that these don't meet in one task.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, label)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        upper = both.filter("b > a")
        large = (split_join(upper, least, ["a"]) if before[0] > SMALL_EDGES else upper.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("x"), "m").unionByName(below.select(F.col("a").alias("x"), "m"))
        edges = staged(small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), label)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
