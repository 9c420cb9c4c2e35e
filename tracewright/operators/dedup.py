"""De-duplication of records: exact, best of a key, and one per cluster of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns).distinct()


def keep_best(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order should end in a unique column."""
    ranked = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__nth = 1").drop("__nth")


def l2(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def centroids(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector of each cluster."""
    each = rows.select(cluster, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def representatives(rows: DataFrame, cluster: str, vector: str, id_column: str) -> DataFrame:
    """The row nearest to its cluster's mean, the smaller id on ties."""
    near = rows.join(centroids(rows, cluster, vector), cluster).withColumn("distance", l2(F.col(vector), F.col("centroid")))
    return near.groupBy(cluster).agg(F.min(F.struct(F.round("distance", 9).alias("distance"), F.col(id_column).alias("id"))).alias("best"), F.count("*").alias("n")).select(cluster, F.col("best.id").alias(id_column), "n")
