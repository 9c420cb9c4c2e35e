"""Predicates on source tasks, messages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of an English task, words of other media, and markers of unusable tasks.
ENGLISH = r"""^[A-Za-z0-9\s.,?!;:'"()\[\]{}\-_*/\\@#$%^&+=<>|~`]*$"""
MEDIA = ("image", "photo", "picture", "video", "audio", "sound", "speech", "clip")
MARKERS = ("Role definition:", "USD", "ETH", "Bitcoin", "Ethereum", "@", ".com", "http:", "https:")


def is_english(text: Column) -> Column:
    return text.rlike(ENGLISH)


def names_media(text: Column) -> Column:
    return F.lower(text).rlike("|".join(MEDIA))


def has_marker(text: Column) -> Column:
    found = F.lit(False)
    for marker in MARKERS:
        found = found | text.contains(marker)
    return found


def usable_task(text: Column) -> Column:
    return is_english(text) & ~names_media(text) & ~has_marker(text)


def is_error(content: Column) -> Column:
    """Text that starts with ``Error:``; null is no error."""
    return F.coalesce(content.startswith("Error:"), F.lit(False))


def at_least(numerator: Column, denominator: Column, percent: int) -> Column:
    """numerator / denominator >= percent / 100 in whole numbers; false over nothing."""
    return (denominator > 0) & (numerator * 100 >= denominator * percent)


def after_thought(text: Column) -> Column:
    return F.element_at(F.split(text, "</think>"), -1)


def turns(messages: DataFrame, key: str, role: str, order: str, text: str) -> DataFrame:
    """Per conversation: number of assistant turns, of tagged-format errors among them, and the last assistant text."""
    own = F.col(role) == "assistant"
    opened = F.col(text).rlike("(?i)[<@]think[>@]") & ~F.col(text).rlike("(?is)[<@]think[>@].*?[<@]/think[>@]")
    unclosed = F.col(text).contains("<tool_call>") & ~F.col(text).contains("</tool_call>")
    return messages.groupBy(key).agg(
        F.count_if(own).alias("n_assistant"),
        F.count_if(own & (opened | unclosed)).alias("n_malformed"),
        F.max_by(text, F.when(own, F.col(order))).alias("last_assistant"),
    )


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows pass each stage and all before it, in one pass."""
    passed, counts = F.lit(True), [F.count("*").alias("n_all")]
    for name, test in stages:
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(*counts)
