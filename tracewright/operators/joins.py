"""Joins of samples with dimensions, hold-out sets, checkpoints and retried results.

No side is broadcast by hand: Spark broadcasts a side whose size it knows to be small and sorts and merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich(samples: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: list[str]) -> DataFrame:
    """Left join on a unique key; samples whose key is null are dropped as malformed, unmatched ones keep nulls."""
    right = dimension.select(F.col(dimension_key).alias("__key"), *columns)
    return samples.where(F.col(key).isNotNull()).join(right, F.col(key) == F.col("__key"), "left").drop("__key")


def exclude(samples: DataFrame, held_out: DataFrame, key: str, present: Column | None = None) -> DataFrame:
    """Samples whose key is not held out. Rows with a null key stay unless ``present`` says that the key must be there."""
    kept = samples.join(held_out.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return kept if present is None else kept.where(present)


def matched(results: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Results with their steps; results of unknown steps are skipped."""
    return results.join(steps, keys)


def pending(steps: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return steps.join(done.select(*keys).distinct(), keys, "left_anti")


def to_retry(steps: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    return steps.join(failed.select(*keys).distinct(), keys, "left_semi")


def merge_retried(results: DataFrame, retried: DataFrame, keys: list[str]) -> DataFrame:
    """Retried results in place of the old ones of their keys; failed results that were not retried stay."""
    return results.join(retried.select(*keys).distinct(), keys, "left_anti").unionByName(retried)


def positional(rows: DataFrame, items: DataFrame, ordinal: str) -> DataFrame:
    """Pairs of the same ordinal; the longer side's rest is left out."""
    return rows.join(items, ordinal)
