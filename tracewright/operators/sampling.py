"""Samples that cover as many environments as their quota allows, deterministic under a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.shared import checkpointed


def coverage_sample(candidates: DataFrame, env: str, id_column: str, quota: int, seed: str, used: list | None = None) -> DataFrame:
    """One row of each unused environment first, then others, each in the order of md5(seed:id).

    A null environment counts as one of its own. ``used`` holds environments that earlier strata took; it is bounded by
    their quotas.
    """
    turn = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string")))
    unit = F.coalesce(F.col(env).cast("string"), F.lit("unknown"))
    rows = candidates.withColumn("__turn", turn).withColumn("__env", unit)
    fresh = rows.where(~F.col("__env").isin([str(u) for u in used])) if used else rows
    # The first row of an environment is a minimum, and no more rows than the quota are ever put in order together.
    first = fresh.groupBy("__env").agg(F.min("__turn").alias("__turn")).orderBy("__turn").limit(quota).select("__turn")
    later = rows.orderBy("__turn").limit(2 * quota).join(first, "__turn", "left_anti")
    both = rows.join(first, "__turn", "left_semi").withColumn("__later", F.lit(0)).unionByName(later.withColumn("__later", F.lit(1)))
    return both.orderBy("__later", "__turn").limit(quota).select(*[f"`{c}`" for c in candidates.columns])


def strata(candidates: DataFrame, env: str, id_column: str, quotas: list[tuple[str, Column, int]], seed: str) -> DataFrame:
    """A coverage sample of each stratum in turn; environments that one stratum took are no longer fresh for the next.

    Each stratum (name, test, quota) takes one row of each fresh environment in the order of md5(seed:name:id), then other rows in that
    order, until its quota is full. A null environment is one of its own; a row may pass several tests and be taken by each;
    a test that gives null is not passed; ties do not arise while ids differ.

    What earlier strata can have used is bounded by their quotas. So of a stratum only the first rows of its first environments and its
    first rows of all can be taken: each is reduced to a few times the sum of quotas before anything is put in order, and
    the turns themselves are a fold over what is left. Nothing is collected.
    """
    reduced = checkpointed(_takeable(candidates, env, id_column, quotas, seed))
    turns = F.array_sort(F.collect_list(F.struct("__n", "__class", "__turn", "__env")))
    most = F.array(*[F.lit(q) for _, _, q in quotas])

    def take(state: Column, row: Column) -> Column:
        """state: places taken (n, turn), environments used, rows of the stratum that is being filled and how many it has."""
        same = state["n"] == row["__n"]
        count = F.when(same, state["count"]).otherwise(0)
        mine = F.when(same, state["mine"]).otherwise(F.array().cast("array<string>"))
        fresh = F.when(row["__class"] == 0, ~F.array_contains(state["used"], row["__env"])).otherwise(~F.array_contains(mine, row["__turn"]))
        taken = fresh & (count < F.get(most, row["__n"]))
        return F.struct(
            row["__n"].alias("n"),
            F.when(taken, count + 1).otherwise(count).alias("count"),
            F.when(taken, F.array_append(mine, row["__turn"])).otherwise(mine).alias("mine"),
            F.when(taken, F.array_append(state["used"], row["__env"])).otherwise(state["used"]).alias("used"),
            F.when(taken, F.array_append(state["taken"], F.struct(row["__n"].alias("__n"), row["__turn"].alias("__turn")))).otherwise(state["taken"]).alias("taken"),
        )

    texts = F.array().cast("array<string>")
    start = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("count"), texts.alias("mine"), texts.alias("used"), F.array().cast("array<struct<__n: int, __turn: string>>").alias("taken"))
    picked = reduced.agg(F.aggregate(turns, start, take, lambda s: s["taken"]).alias("taken")).select(F.inline("taken"))
    rows = reduced.where("__class = 1").join(picked, ["__n", "__turn"])
    return rows.select("__row.*", "stratum")


def _takeable(candidates: DataFrame, env: str, id_column: str, quotas: list[tuple[str, Column, int]], seed: str) -> DataFrame:
    """Of each stratum the first rows of its first environments (class 0) and its first rows (class 1), as many as can be taken."""
    tests = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("__n"), F.lit(name).alias("stratum"))) for i, (name, test, _) in enumerate(quotas)]
    row = F.struct(*[candidates[f"`{c}`"] for c in candidates.columns])
    tagged = candidates.select(row.alias("__row"), F.coalesce(F.col(env).cast("string"), F.lit("unknown")).alias("__env"), F.col(id_column).cast("string").alias("__id"), F.inline(F.array_compact(F.array(*tests))))
    tagged = tagged.withColumn("__turn", F.md5(F.concat_ws(":", F.lit(seed), "stratum", "__id"))).drop("__id")
    used = [sum(q for _, _, q in quotas[:i]) for i in range(len(quotas))]
    room = F.array(*[F.lit(u + q) for u, (_, _, q) in zip(used, quotas, strict=True)])
    quota = F.array(*[F.lit(q) for _, _, q in quotas])
    first = tagged.groupBy("__n", "stratum", "__env").agg(F.min("__turn").alias("__turn"))
    order = Window.partitionBy("__n").orderBy("__turn")
    most = max(u + 2 * q for u, (_, _, q) in zip(used, quotas, strict=True)) if quotas else 0
    envs = first.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= most).where(F.col("__nth") <= F.get(room, F.col("__n")))
    rows = tagged.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= most).where(F.col("__nth") <= F.get(room, F.col("__n")) + F.get(quota, F.col("__n")))
    # Rows of environments that may be taken first but stand behind the first rows of all.
    behind = tagged.join(envs.select("__n", "__turn"), ["__n", "__turn"], "left_semi").join(rows.select("__n", "__turn"), ["__n", "__turn"], "left_anti")
    every = rows.drop("__nth").unionByName(behind)
    return every.withColumn("__class", F.lit(1)).unionByName(every.join(envs.select("__n", "__turn"), ["__n", "__turn"], "left_semi").withColumn("__class", F.lit(0)))
