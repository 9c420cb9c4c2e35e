"""Nested states as rows: one fact (path, kind, value) for each part of a VARIANT, so that states are compared and checked by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean, null or other; null where there is no value."""
    told = F.schema_of_variant(value)
    return (
        F.when(told.startswith("OBJECT"), "object")
        .when(told.startswith("ARRAY"), "array")
        .when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean")
        .when(told == "VOID", "null")
        .when(told.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(told.isNotNull(), "other")
    )


def number_of(value: Column) -> Column:
    return F.when(kind_of(value) == "number", F.try_variant_get(value, "$", "double"))


def _children(value: str, arrays: bool) -> Column:
    """Steps and values of the parts of an object (by key) or array (by place); empty for anything else."""
    entries = F.expr(f"transform(map_entries(try_cast({value} as map<string, variant>)), e -> struct(e.key as step, e.value as v))")
    elements = F.expr(f"transform(try_cast({value} as array<variant>), (x, i) -> struct(cast(i as string) as step, x as v))")
    kind = kind_of(F.col(value))
    return F.when(kind == "object", entries).when((kind == "array") & F.lit(arrays), elements)


def flattened(rows: DataFrame, state: str, depth: int, arrays: bool = True) -> DataFrame:
    """``rows`` without ``state`` but with path (array of steps) and v (a VARIANT): one row for each part of the state down to
    ``depth`` steps, its root included; without ``arrays`` these are not opened. A null state, and one that is no JSON, has no facts. One pass: every step explodes
    what the step before has found, and keeps it."""
    kept = [c for c in rows.columns if c != state]
    facts = rows.where(F.col(state).isNotNull()).select(*kept, F.array().cast("array<string>").alias("path"), F.col(state).alias("v"), F.lit(True).alias("__new"))
    for _ in range(depth):
        own = F.array(F.struct("path", "v", F.lit(False).alias("__new")))
        below = F.transform(F.col("__parts"), lambda c: F.struct(F.concat("path", F.array(c["step"])).alias("path"), c["v"].alias("v"), F.lit(True).alias("__new")))
        grown = facts.withColumn("__parts", F.when(F.col("__new"), _children("v", arrays)))
        facts = grown.select(*kept, F.explode(F.when(F.col("__parts").isNull(), own).otherwise(F.concat(own, below))).alias("__f")).select(*kept, "__f.*")
    return facts.drop("__new")


def described(facts: DataFrame) -> DataFrame:
    """``facts`` with kind, text (JSON, members by name) and number in place of the VARIANT, so that they can be compared and grouped."""
    kept = [c for c in facts.columns if c != "v"]
    return facts.select(*kept, kind_of(F.col("v")).alias("kind"), F.to_json("v").alias("text"), number_of(F.col("v")).alias("number"))
