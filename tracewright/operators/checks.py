"""Declarative checks on final states: rules in a table meet the facts of each state, and a check's rules are put together by grouping.

A rule has env, check_id, rule_id, mode, path, quantifier, operator and literal:

* ``path`` is an array of steps (keys, or places in arrays); ``*`` stands for every key or place;
* ``operator`` is one of exists, eq, ne, lt, le, gt, ge, type, nonempty, contains, starts, ends, added, changed, same; the last
  three compare with the fact at the same path of the initial state;
* ``literal`` is JSON text; numbers are equal by value, strings compare with strings only;
* ``quantifier`` says how many of the facts that the path names must pass: ``any``, ``all`` (at least one, and each) or ``none``;
* ``mode`` puts the rules of a check together: ``all`` or ``any``.

A rule that cannot be evaluated (an unknown operator, or an order of unlike kinds) gives null, and so does its check: it
counts as a check that did not pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import facts

RULE = "env string, check_id string, rule_id int, mode string, path array<string>, quantifier string, operator string, literal string"


def _test() -> Column:
    """Whether one fact passes one rule; null where that cannot be told."""
    operator, kind, lit_kind = F.col("operator"), F.col("kind"), F.col("lit_kind")
    numbers = (kind == "number") & (lit_kind == "number")
    strings = (kind == "string") & (lit_kind == "string")
    equal = F.when(numbers, F.col("number") == F.col("lit_number")).otherwise(F.col("text") == F.col("lit_text"))

    def ordered(compare) -> Column:
        return F.when(numbers, compare(F.col("number"), F.col("lit_number"))).when(strings, compare(F.col("own"), F.col("lit_own")))

    def of_strings(compare) -> Column:
        return F.when(strings, compare(F.col("own"), F.col("lit_own")))

    filled = F.when(kind.isin("object", "array"), ~F.col("text").isin("{}", "[]")).when(kind == "string", F.trim("own") != "").otherwise(kind != "null")
    return (
        F.when(operator == "exists", True)
        .when(operator == "eq", equal)
        .when(operator == "ne", ~equal)
        .when(operator == "lt", ordered(lambda a, b: a < b))
        .when(operator == "le", ordered(lambda a, b: a <= b))
        .when(operator == "gt", ordered(lambda a, b: a > b))
        .when(operator == "ge", ordered(lambda a, b: a >= b))
        .when(operator == "type", F.coalesce(kind == F.col("lit_own"), F.lit(False)))
        .when(operator == "nonempty", filled)
        .when(operator == "contains", of_strings(lambda a, b: F.contains(a, b)))
        .when(operator == "starts", of_strings(lambda a, b: F.startswith(a, b)))
        .when(operator == "ends", of_strings(lambda a, b: F.endswith(a, b)))
        .when(operator == "added", F.col("text_before").isNull())
        .when(operator == "changed", F.col("text_before").isNotNull() & (F.col("text_before") != F.col("text")))
        .when(operator == "same", F.coalesce(F.col("text_before") == F.col("text"), F.lit(False)))
    )


KNOWN = ("exists", "eq", "ne", "lt", "le", "gt", "ge", "type", "nonempty", "contains", "starts", "ends", "added", "changed", "same")


def _own_text(text: Column, kind: Column) -> Column:
    """The characters of a JSON string."""
    return F.when(kind == "string", F.try_variant_get(F.try_parse_json(text), F.lit("$"), "string"))


def rule_results(states: DataFrame, rules: DataFrame) -> DataFrame:
    """id, check_id, rule_id, mode, holds for each state (id, env, initial, final: JSON texts) and rule of its env.

    A state without rules has no rows; a null or unreadable final state has no facts, so only rules of ``none`` hold for it.
    ``id`` must be unique; rows with a null id or env are left out. Only as many steps of a state are opened as the longest path has.
    """
    states = states.where(F.col("id").isNotNull() & F.col("env").isNotNull())
    depth = rules.agg(F.max(F.size("path"))).first()[0] or 0
    after = facts.described(facts.flattened(states.select("id", "env", F.try_parse_json("final").alias("state")), "state", depth))
    before = facts.described(facts.flattened(states.select("id", F.try_parse_json("initial").alias("state")), "state", depth)).select("id", "path", F.col("text").alias("text_before"))
    both = after.withColumn("own", _own_text(F.col("text"), F.col("kind"))).join(before, ["id", "path"], "left")
    literal = F.try_parse_json("literal")
    read = rules.select("*", facts.kind_of(literal).alias("lit_kind"), F.to_json(literal).alias("lit_text"), facts.number_of(literal).alias("lit_number"))
    read = read.withColumn("lit_own", _own_text(F.col("lit_text"), F.col("lit_kind")))
    # A fact meets the rules whose path is its own, or its own with stars where the rule has them: one join on equal paths.
    masks = rules.select(F.transform("path", lambda s: s == "*").alias("mask")).distinct().withColumn("steps", F.size("mask"))
    starred = both.withColumn("steps", F.size("path")).join(masks, "steps").withColumn("path", F.zip_with("path", "mask", lambda s, m: F.when(m, F.lit("*")).otherwise(s)))
    met = starred.join(read, ["env", "path"]).withColumn("passes", _test())
    told = met.groupBy("id", "check_id", "rule_id").agg(F.count("*").alias("n"), F.count_if("passes").alias("n_pass"), F.count_if(F.col("passes").isNull()).alias("n_unknown"))
    every = states.select("id", "env").join(rules.select("env", "check_id", "rule_id", "mode", "quantifier", "operator"), "env").join(told, ["id", "check_id", "rule_id"], "left")
    n, n_pass = F.coalesce("n", F.lit(0)), F.coalesce("n_pass", F.lit(0))
    holds = F.when(F.col("quantifier") == "any", n_pass > 0).when(F.col("quantifier") == "all", (n > 0) & (n_pass == n)).when(F.col("quantifier") == "none", n_pass == 0)
    known = F.col("operator").isin(*KNOWN) & (F.coalesce("n_unknown", F.lit(0)) == 0)
    return every.select("id", "check_id", "rule_id", "mode", F.when(known, holds).alias("holds"))


def check_results(states: DataFrame, rules: DataFrame) -> DataFrame:
    """id, check_id, passed: null where one of the check's rules could not be evaluated."""
    told = rule_results(states, rules).groupBy("id", "check_id").agg(F.bool_and("holds").alias("each"), F.bool_or("holds").alias("some"), F.count_if(F.col("holds").isNull()).alias("unknown"), F.max("mode").alias("mode"))
    return told.select("id", "check_id", F.when(F.col("unknown") == 0, F.when(F.col("mode") == "any", F.col("some")).otherwise(F.col("each"))).alias("passed"))


def rewards(results: DataFrame) -> DataFrame:
    """id, n_checks, n_passed, n_failed_to_run, reward (passed over all checks, to four places)."""
    told = results.groupBy("id").agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"), F.count_if(F.col("passed").isNull()).alias("n_failed_to_run"))
    return told.withColumn("reward", F.round(F.col("n_passed") / F.col("n_checks"), 4))
