"""Operators on trajectories: steps in order, states carried forward, differences, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import udfs


def number_steps(steps: DataFrame, by: list[str], order: list[str], name: str = "step", start: int = 1) -> DataFrame:
    return steps.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1))


def carry_forward(steps: DataFrame, by: list[str], order: list[str], state: str, before: str = "state_before", after: str = "state_after") -> DataFrame:
    """``before`` is the last state known earlier in the trajectory; a step without a state of its own keeps it as ``after``."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn(before, F.last(state, ignorenulls=True).over(earlier)).withColumn(after, F.coalesce(F.col(state), F.col(before)))


def previous_state(steps: DataFrame, by: list[str], order: list[str], state: str, name: str = "previous") -> DataFrame:
    return steps.withColumn(name, F.lag(state).over(Window.partitionBy(*by).orderBy(*order)))


def attach_changes(steps: DataFrame, before: str, after: str, by_value: bool = False) -> DataFrame:
    """Adds ``changes`` and ``change_count`` of two JSON state columns."""
    diff = udfs.state_changes_by_value if by_value else udfs.state_changes
    found = steps.withColumn("changes", diff(F.coalesce(before, F.lit("{}")), F.coalesce(after, F.lit("{}"))))
    return found.withColumn("change_count", F.size("changes"))


def explode_steps(trajectories: DataFrame, steps: str, position: str = "position", name: str = "step_detail") -> DataFrame:
    """One row per step; trajectories without steps vanish."""
    return trajectories.select(*[c for c in trajectories.columns if c != steps], F.posexplode(steps).alias(position, name))


def single_or_all(samples: DataFrame, single: str, many: str, position: str = "position", name: str = "step_detail") -> DataFrame:
    """Steps of a table that holds either one step or a list of them per row."""
    steps = F.coalesce(F.when(F.col(single).isNotNull(), F.array(single)), F.col(many))
    return samples.select(*[c for c in samples.columns if c not in (single, many)], F.posexplode(steps).alias(position, name))


def regroup_steps(steps: DataFrame, by: list[str], position: str, columns: list[str], name: str = "trajectory") -> DataFrame:
    """Back to one row per trajectory, its steps in order."""
    ordered = F.sort_array(F.collect_list(F.struct(position, *columns)))
    return steps.groupBy(*by).agg(ordered.alias(name))


def classify(success: Column, change_count: Column, arguments: Column) -> Column:
    """Label of a step by outcome, number of changes and number of arguments; null where none of the strata holds it."""
    unchanged = F.when(arguments == 0, "first_change0_args0").when(arguments == 1, "first_change0_args1")
    changed = (
        F.when(change_count.between(1, 2), F.concat(F.lit("second_simple_"), change_count.cast("string")))
        .when(change_count.between(3, 6), F.concat(F.lit("second_medium_"), change_count.cast("string")))
        .when(change_count.between(7, 12), "second_difficult_7_12")
    )
    return F.when(success == F.lit(False), "first_success_false").when((success == F.lit(True)) & (change_count == 0), unchanged).otherwise(changed)
