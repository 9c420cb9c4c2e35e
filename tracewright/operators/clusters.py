"""k-means with a defined result: farthest-first seeds and a fixed number of rounds, as aggregations against a small table of centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 9  # to which distances and means are rounded, so that the order of a sum decides nothing


def _distance(vector: Column, centroid: Column) -> Column:
    squares = F.zip_with(vector, centroid, lambda x, y: (x - y) * (x - y))
    return F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), PLACES)


def _table(centroids: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])


def _nearest(vector: Column, centroids: list[list[float]]) -> Column:
    """(distance, cluster) of the nearest centroid, the smaller number on ties."""
    return F.array_min(F.transform(_table(centroids), lambda c, i: F.struct(_distance(vector, c).alias("distance"), i.alias("cluster"))))


def _vectors(rows: DataFrame, vector: str, id_column: str) -> DataFrame:
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return rows.where(usable & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))


def farthest_first(rows: DataFrame, vector: str, id_column: str, k: int) -> list[list[float]]:
    """``k`` seeds, fewer if there are not as many different vectors: the vector of the smallest id, then again and again the one whose
    nearest seed is farthest, the smaller id on ties. One aggregation a seed; only the seeds come to the driver."""
    vectors = _vectors(rows, vector, id_column)
    first = vectors.agg(F.min_by("v", "id").alias("v")).first()["v"]
    seeds = [] if first is None else [first]
    while seeds and len(seeds) < k:
        far = vectors.select("id", "v", _nearest(F.col("v"), seeds)["distance"].alias("d"))
        best = far.agg(F.max("d").alias("d"), F.max_by("v", F.struct("d", -F.col("id"))).alias("v")).first()
        if not best["d"] > 0:
            break
        seeds.append(best["v"])
    return seeds


def kmeans(rows: DataFrame, vector: str, id_column: str, k: int, rounds: int = 5) -> DataFrame:
    """``rows`` with ``cluster``: the nearest of ``k`` centroids after ``rounds`` rounds of assignment and means from farthest-first seeds.

    Every row has one result: distances and means are rounded to nine places, ties go to the smaller cluster number, and a cluster that loses all
    its rows keeps its centroid. Null, empty or NaN vectors and null ids get a null cluster and move no centroid; rows that repeat an
    id count each; fewer different vectors than ``k`` give fewer clusters; vectors must be of one length. ``k`` vectors
    are held by the driver and sent with the plan; rows are aggregated where they are.
    """
    centroids = farthest_first(rows, vector, id_column, k)
    if not centroids:
        return rows.withColumn("cluster", F.lit(None).cast("int"))
    vectors = _vectors(rows, vector, id_column)
    for _ in range(rounds):
        near = vectors.select(_nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v").select("cluster", F.posexplode("v").alias("i", "x"))
        means = near.groupBy("cluster", "i").agg(F.round(F.avg("x"), PLACES).alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
        moved = {r["cluster"]: r["m"] for r in means.collect()}  # at most k rows
        centroids = [moved.get(c, old) for c, old in enumerate(centroids)]
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.col(id_column).isNotNull()
    return rows.withColumn("cluster", F.when(usable, _nearest(F.transform(vector, lambda x: x.cast("double")), centroids)["cluster"]))
