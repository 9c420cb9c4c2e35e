"""Environments' sources as text columns: names and definitions of classes, assembly, imports, sources of functions, ends of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDENT = "    "
#: Fixed by the protocol of conversations.
DONE, FAILED, STOP = "Task Completed", "Task Failed", "###STOP###"


def _lines(text: Column) -> Column:
    """Lines without a last empty one behind the final line feed."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def class_name(source: Column) -> Column:
    """The last class without bases that is named before ``__init__``; else what stands between the last ``class`` and its colon."""
    head = F.substring_index(source, "def __init__", 1)
    named = F.regexp_extract_all(head, F.lit(r"(?U)class\s+(\w+)\s*:"), 1)
    return F.coalesce(F.try_element_at(named, F.lit(-1)), _stripped(F.substring_index(F.substring_index(head, "class ", -1), ":", 1)))


def class_definition(source: Column, name: Column) -> Column:
    """Everything up to the end of ``__init__``; null where the class or its ``__init__`` is missing."""
    mark = F.concat(F.lit("class "), name)
    body, init = F.split_part(source, mark, F.lit(2)), F.lit("def __init__")
    there = F.contains(source, mark) & F.contains(body, init)
    own = F.concat(F.split_part(source, mark, F.lit(1)), mark, F.split_part(body, init, F.lit(1)), init, F.split_part(F.split_part(body, init, F.lit(2)), F.lit("def "), F.lit(1)))
    return F.when(there, own)


def assembled(definition: Column, methods: Column) -> Column:
    """A class definition with methods (array of texts) put behind its ``__init__``, indented; null where there is no ``__init__``."""
    lines = _lines(definition)
    at = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(F.ltrim(x).startswith("def __init__"), i)), lambda i: i.isNotNull()))
    following = F.filter(F.transform(lines, lambda x, i: F.when((i > at) & x.startswith(f"{INDENT}def "), i)), lambda i: i.isNotNull())
    kept = F.coalesce(F.array_min(following), F.size(lines))
    indented = F.flatten(F.transform(methods, lambda m: F.array_append(F.transform(_lines(_stripped(m)), lambda x: F.when(F.trim(x) != "", F.concat(F.lit(INDENT), x)).otherwise(x)), F.lit(""))))
    whole = F.concat(F.slice(lines, 1, kept), F.array(F.lit("")), indented, F.slice(lines, kept + 1, F.size(lines)))
    return F.when(at.isNotNull(), F.array_join(whole, "\n"))


def hoisted(source: Column) -> Column:
    """Imports, wherever they stand, moved to the top: each once, in the order in which they first appear."""
    lines = _lines(source)
    imports = lambda x: F.trim(x).rlike(r"^(import .+|from .+ import .+)")
    first = F.array_distinct(F.transform(F.filter(lines, imports), lambda x: F.trim(x)))
    others = F.filter(lines, lambda x: ~imports(x))
    return F.concat(_stripped(F.array_join(F.concat(F.when(F.size(first) > 0, F.array_append(first, F.lit(""))).otherwise(first), others), "\n")), F.lit("\n"))


def function_sources(environments: DataFrame, key: str, source: str) -> DataFrame:
    """key, function, source of each method of each class, in rows."""
    pieces = F.filter(F.split(F.col(source), rf"(?m)^(?={INDENT}(?:async )?def )"), lambda p: p.rlike(rf"^{INDENT}(?:async )?def \w+"))
    each = environments.select(key, F.explode(pieces).alias("source"))
    return each.select(key, F.regexp_extract("source", r"def (\w+)", 1).alias("function"), F.regexp_replace("source", r"\s+\z", "").alias("source"))


def with_sources(cases: DataFrame, environments: DataFrame, key: str, function: str, source: str) -> DataFrame:
    """``cases`` with the source of the function that they call, null where the class has none; a function defined twice is its last definition."""
    known = function_sources(environments, key, source).groupBy(key, F.col("function").alias(function)).agg(F.max_by("source", F.length("source")).alias("function_source"))
    return cases.join(known, [key, function], "left")


def ordered_cases(cases: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per function with its cases in order; ``columns`` decide between cases whose order is equal, so there is one result."""
    return cases.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *columns))), lambda s: F.struct(*[s[c].alias(c) for c in columns])).alias("cases"))


def has_member(record: Column, name: str) -> Column:
    """Whether a JSON object has a member, also one that is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(record), name), F.lit(False))


def ended(mode: Column, name: Column, content: Column, observation: Column) -> Column:
    """Whether work has ended, by its mode: ``conversation`` by an observation that says STOP, ``single`` by a message that says it is
    done or failed, ``any_message`` by any message to the user."""
    chat = name == "chat_with_user"
    said = F.contains(content, F.lit(DONE)) | F.contains(content, F.lit(FAILED))
    return F.coalesce(chat & F.when(mode == "conversation", F.contains(observation, F.lit(STOP))).when(mode == "single", said).when(mode == "any_message", True), F.lit(False))


def write_sources(environments: DataFrame, key: str, source: str, path: str) -> None:
    """A folder per environment with its source as text; rows without a key are skipped."""
    environments.where(F.col(key).isNotNull()).select(key, F.col(source).alias("value")).write.partitionBy(key).text(path)
