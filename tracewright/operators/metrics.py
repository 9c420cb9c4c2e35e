"""Roll-ups of evaluation results and test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The leaves of the category tree with their branch.
LEAVES = {
    "first_success_false": "first",
    "first_change0_args0": "first",
    "first_change0_args1": "first",
    "second_simple_1": "second",
    "second_simple_2": "second",
    "second_medium_3": "second",
    "second_medium_4": "second",
    "second_medium_5": "second",
    "second_medium_6": "second",
    "second_difficult_7_12": "second",
}


def hits(results: DataFrame, by: list[str], feedback: str, state: str, error: str | None = None) -> DataFrame:
    """Counts and hits per category; with ``error`` named, rows that failed are left out of the denominator."""
    rows = results if error is None else results.where(F.col(error).isNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(feedback).alias("feedback_hits"), F.count_if(state).alias("state_hits"))


def category_tree(results: DataFrame, leaf: str, feedback: str, state: str) -> DataFrame:
    """Leaves, branches and the total with counts and hits; every leaf of the fixed tree appears, with zeros if need be."""
    spark = results.sparkSession
    leaves = spark.createDataFrame(list(LEAVES.items()), "leaf string, branch string")
    counted = hits(results, [leaf], feedback, state).withColumnRenamed(leaf, "leaf")
    full = leaves.join(counted, "leaf", "left").na.fill(0)
    sums = [F.sum(c).alias(c) for c in ("n", "feedback_hits", "state_hits")]
    rolled = full.rollup("branch", "leaf").agg(F.grouping_id().alias("level"), *sums)
    name = F.when(F.col("level") == 0, F.col("leaf")).when(F.col("level") == 1, F.col("branch")).otherwise("overall")
    return rolled.select(name.alias("category"), *("n", "feedback_hits", "state_hits"))


def test_cases(cases: DataFrame, by: str, status: Column, positive: Column) -> DataFrame:
    """The twelve counters per function and over all (null function)."""
    rows = cases.select(F.col(by).alias("unit"), status.alias("status"), positive.alias("positive"))
    counters = [F.count("*").alias("total_count")]
    for s in ("pass", "warning", "fail"):
        counters.append(F.count_if(F.col("status") == s).alias(f"{s}_count"))
    for sign, test in (("positive", F.col("positive")), ("negative", ~F.col("positive"))):
        counters.append(F.count_if(test).alias(f"{sign}_count"))
        counters += [F.count_if(test & (F.col("status") == s)).alias(f"{sign}_{s}_count") for s in ("pass", "warning", "fail")]
    return rows.rollup("unit").agg(*counters)


def normal_status(status: Column, passed: Column) -> Column:
    """pass, warning or fail from a status text, else from the older flag, else fail."""
    clean = F.lower(F.trim(status))
    return F.when(clean.isin("pass", "warning", "fail"), clean).when(passed, "pass").otherwise("fail")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The value at place floor(n / 2) + 1 of the ascending order, from counts per value."""
    counts = rows.groupBy(value).agg(F.count("*").alias("__n"))
    # Distinct values are few (turn counts), so the running sum over them is small.
    placed = counts.select(value, F.sum("__n").over(Window.orderBy(value)).alias("__upto"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    return placed.where(F.col("__upto") >= F.floor(F.col("__total") / 2) + 1).agg(F.min(value).alias("upper_median"))


def reward(checks: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """Checks passed over all checks; a check that could not run counts in the denominator only."""
    return checks.groupBy(*by).agg(F.count_if(F.coalesce(passed, F.lit(False))).alias("n_passed"), F.count("*").alias("n_checks"))


def running_counts(steps: DataFrame, by: list[str], order: list[str], test: Column, name: str) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(name, F.sum(test.cast("long")).over(upto))


def percent(part: Column, whole: Column) -> Column:
    """Null over nothing."""
    return F.when(whole > 0, 100 * part.cast("double") / whole)


#: Groups of leaves between branch and leaf.
TIERS = {"simple": (1, 2), "medium": (3, 6), "difficult": (7, 12)}


def full_tree(results: DataFrame, leaf: str, change_count: str, feedback: str, state: str) -> DataFrame:
    """Leaves, tiers, the difficult tier by change count, branches and the total: counts, hits and percentages.

    Every category of the fixed tree appears; an empty one has zeros and no percentages. A result counts in every category
    that holds its leaf, and the counts are added up in each task before they are shuffled.
    """
    spark = results.sparkSession
    names = [*LEAVES, *TIERS, *[f"difficult_{n}" for n in range(7, 13)], "first", "second", "overall"]
    own = [F.col(leaf)]
    own.append(F.when(F.col(leaf).startswith("first_"), "first").when(F.col(leaf).startswith("second_"), "second"))
    for tier in TIERS:
        own.append(F.when(F.col(leaf).startswith(f"second_{tier}_"), tier))
    own.append(F.when(F.col(leaf).startswith("second_difficult_"), F.concat(F.lit("difficult_"), F.col(change_count).cast("string"))))
    own.append(F.when(F.col(leaf).isin(*LEAVES), "overall"))
    each = results.select(F.explode(F.array_compact(F.array(*own))).alias("category"), feedback, state)
    counted = hits(each, ["category"], feedback, state)
    full = spark.createDataFrame([(n,) for n in names], "category string").join(counted, "category", "left").na.fill(0)
    return full.withColumns({"feedback_pct": percent(F.col("feedback_hits"), F.col("n")), "state_pct": percent(F.col("state_hits"), F.col("n"))})


def accuracies(counted: DataFrame) -> DataFrame:
    """Rates of test_cases' counters, to two places; null over nothing."""
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.round(part.cast("double") / F.col(whole), 2))
    return counted.select(
        "unit",
        rate(F.col("pass_count") + F.col("warning_count"), "total_count").alias("not_fail_acc"),
        rate(F.col("positive_pass_count") + F.col("positive_warning_count"), "positive_count").alias("positive_not_fail_acc"),
        rate(F.col("pass_count"), "total_count").alias("pass_acc"),
    )


def mean_reward(results: DataFrame, reward_column: str) -> DataFrame:
    """Number of results and a hundred times their mean reward, to two places; no row without results."""
    found = results.agg(F.count("*").alias("n"), F.round(F.sum(reward_column) * 100 / F.count("*"), 2).alias("avg_score"))
    return found.where("n > 0")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Rows per value, with the mean over all (two places) and the upper median beside each."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per distinct value
    total, mean = F.sum("n").over(every), F.sum(F.col(value) * F.col("n")).over(every)
    placed = counts.withColumn("__upto", F.sum("n").over(Window.orderBy(value))).withColumn("mean", F.round(mean / total, 2)).withColumn("__half", F.floor(total / 2) + 1)
    middle = F.min(F.when(F.col("__upto") >= F.col("__half"), F.col(value))).over(every)
    return placed.select(value, "n", "mean", middle.alias("upper_median"))


def reward_ratio(checks: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """reward with its ratio, to four places."""
    return reward(checks, by, passed).withColumn("ratio", F.round(F.col("n_passed").cast("double") / F.col("n_checks"), 4))


def checkpoint_status(ran: Column, value: Column) -> Column:
    """Pass above a half; what could not be run is an error, and what was not tried is not evaluated."""
    return F.when(ran.isNull(), "Not evaluated").when(~ran | value.isNull(), "Error").when(value > 0.5, "Pass").otherwise("Fail")


def checkpoint_scores(checks: DataFrame, by: list[str], ran: Column, value: Column) -> DataFrame:
    """Per result: checkpoints passed, all of them, and the mean score over all (four places; null where the sum is not above zero)."""
    rows = checks.withColumns({"__status": checkpoint_status(ran, value), "__value": value})
    counted = F.col("__status").isin("Pass", "Fail")
    total = F.sum(F.when(counted, F.col("__value")).otherwise(0.0))
    return rows.groupBy(*by).agg(F.count_if(F.col("__status") == "Pass").alias("n_passed"), F.count("*").alias("n_checks"), F.when(total > 0, F.round(total / F.count("*"), 4)).alias("avg_score"))
