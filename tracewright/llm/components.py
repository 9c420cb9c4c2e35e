"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked to the smallest of these; edges come as a < b, so b is u."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), "b"))


def _settled(edges: DataFrame) -> bool:
    """Every node above its root has one link and no root stands above another: with a < b the links are the answer."""
    nodes = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("up")), F.struct(F.col("b").alias("v"), F.lit(1).alias("up")))).alias("x")).select("x.v", "x.up")
    each = nodes.groupBy("v").agg(F.max("up").alias("child"), F.min("up").alias("always"), F.sum("up").alias("links"))
    return each.where("links > 1 or child <> always").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` has columns a, b (long). Returns node, component (smallest node reachable) for every node that has a link.

    Null ends and self links are ignored; repeated links count once; without links the result is empty. Each round is
    written to the shared folder. A hub's links are pre-aggregated to one minimum before they are shuffled.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = common.staged(edges, "links")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        after = common.staged(_small_star(_large_star(edges)).distinct(), "links")
        common.drop_staged(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
