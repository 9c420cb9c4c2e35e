"""Training rows, identifiers and section parsing, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import shared


def padded_ids(rows: DataFrame, order: list[str], name: str = "sample_id", start: int = 1, width: int = 3, prefix: str = "") -> DataFrame:
    """Sequential ids in order, zero-padded; wider numbers are not cut.

    Rows are dealt into ranges of the order columns, sorted there and checkpointed once, so the number of rows before
    each range and the place in it come from the same partitions, and no single task orders the whole table.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared.checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row per partition
    number = F.col("__before") + nth + start
    numbered = placed.withColumn("__part", part).join(before, "__part")
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.format_string(f"%0{width}d", number))).drop("__part", "__at", "__before")


def normalized(text: Column) -> Column:
    """Backslashes not before n, t, r or a double quote are doubled; NUL and carriage returns go; null is empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r'\\(?![ntr"])', r"\\\\")
    return F.translate(doubled, "\x00\r", "")


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r",\s*([}\]])", "$1")


def training_row(instruction: str, source: Column, target: Column) -> list[Column]:
    return [F.lit(instruction).alias("instruction"), source.alias("input"), target.alias("output")]


def tagged(text: Column, tag: str) -> Column:
    """Trimmed text between the first ``<tag>`` and its end; null without one."""
    found = F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?is)<{tag}>.*?</{tag}>"), F.trim(found))


def section(text: Column, header: str) -> Column:
    """Text under ``# header`` up to the next header."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?s)# \Q{header}\E\s*\n(.*?)(?=\n# |\z)", 1), r"^\s+|\s+$", "")


def score(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"\Q{name}\E:\s*(\d+)", 1).try_cast("int")


def file_name(text: Column, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), 1, longest)


def bullet_rules(introduction: Column, rules: Column) -> Column:
    return F.concat(introduction, F.lit("\n"), F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n"))


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def titled(summary: Column, introduction: Column) -> Column:
    """Text to be embedded; a null part reads None."""
    return F.concat(F.lit("**"), F.coalesce(summary, F.lit("None")), F.lit("**: "), F.coalesce(introduction, F.lit("None")))


def introduction(text: Column, rules: Column) -> Column:
    """What an agent is told of its environment."""
    lines = F.array_join(F.transform(F.coalesce(rules, F.array().cast("array<string>")), lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), "")
    return F.concat(F.lit("# Environment Information\n\n## Brief Introduction:  \n"), text, F.lit("\n\n## Environment Rules / Constraints:  \n"), lines)


def with_reason(output: Column, reason: Column) -> Column:
    """The reason framed by line feeds before the output; no reason leaves it alone."""
    return F.when(F.coalesce(reason, F.lit("")) == "", output).otherwise(F.concat(F.lit("\n"), reason, F.lit("\n\n"), output))


def reason_or_skip(changes: Column, reason: Column, skip: bool = True) -> Column:
    """With ``skip``, rows without changes get an empty reason."""
    return F.when(F.lit(skip) & (F.size(changes) <= 0), F.lit("")).otherwise(reason)


def tool_name(call: Column) -> Column:
    """Name in front of the first parenthesis; empty where the call does not start with one."""
    return F.regexp_extract(call, r"^(\w+)\(", 1)


def task_of_dialogue(dialogue: Column) -> Column:
    """The user's request in a transcript: from the first ``User:`` up to the next turn, request or time."""
    own = F.get(F.split(dialogue, "User:", -1), F.lit(1))
    for mark in ("\nGenerate API Request: ", "\nAPI-Request: ", "TIME: "):
        own = F.substring_index(own, mark, 1)
    trimmed = F.regexp_replace(own, r"^\s+|\s+$", "")
    return F.substring_index(trimmed, "\nAI: ", 1)


def first_user_turn(turns: Column, speaker: str = "from", text: str = "value") -> Column:
    """Text of the first turn, which must be the user's; anything else fails the job."""
    first = F.get(turns, F.lit(0))
    return F.when(first[speaker] == "user", first[text]).otherwise(F.raise_error(F.lit("the first turn is not the user's")))


def entities(text: Column) -> Column:
    """entity, attributes, description of each ``- Entity: `` block; none without such a block."""
    part = lambda block, i, head: F.trim(F.regexp_replace(F.trim(F.get(F.split(block, "\n", -1), F.lit(i))), f"^- {head}: ", ""))
    blocks = F.slice(F.split(text, "- Entity: ", -1), 2, 1 << 20)
    return F.transform(blocks, lambda b: F.struct(part(b, 0, "Entity").alias("entity"), part(b, 1, "Attributes").alias("attributes"), part(b, 2, "Description").alias("description")))


def rules(text: Column) -> Column:
    """What stands after each ``- ``, trimmed."""
    return F.transform(F.slice(F.split(text, "- ", -1), 2, 1 << 20), lambda r: F.regexp_replace(r, r"^\s+|\s+$", ""))


def checklist(text: Column) -> Column:
    """Items under ``# CheckList`` up to the next header, thoughts left out."""
    shown = F.when(text.contains("</think>"), F.get(F.split(text, "</think>", -1), F.lit(1))).otherwise(text)
    lines = F.transform(F.split(shown, r"\r\n|\n|\r"), lambda x: F.trim(F.translate(x, "\t", " ")))
    begins = F.array_position(F.transform(lines, lambda x: x.startswith("# CheckList")), True)
    after = F.slice(lines, (begins + 1).cast("int"), F.size(lines))
    stops = F.array_position(F.transform(after, lambda x: x.startswith("# ") & ~x.startswith("# CheckList")), True)
    inside = F.when(stops > 0, F.slice(after, 1, (stops - 1).cast("int"))).otherwise(after)
    items = F.transform(F.filter(inside, lambda x: x.startswith("- ")), lambda x: F.trim(F.substr(x, F.lit(3))))
    return F.when(begins > 0, items).otherwise(F.array().cast("array<string>"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cells]), F.lit(" |"))


def stats_line(tool: Column, counts: list[Column]) -> Column:
    return F.concat_ws(" | ", tool, *[F.coalesce(c, F.lit(0)).cast("string") for c in counts])


def stamp(moment: Column, zone_free: str = "yyyyMMdd_HHmmss") -> Column:
    return F.date_format(moment, zone_free)
