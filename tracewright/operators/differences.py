"""Differences of two nested states without Python: both are walked together, so nothing is joined and only what they share is opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import facts

CHANGE = "array<struct<path: string, type: string, before: string, after: string, note: string>>"


def nesting(text: Column) -> Column:
    """How many brackets are open at most at one place of a JSON text; 0 for null."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda s, m: F.struct((now := s["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], now).alias("most"))
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"]), F.lit(0))


def _members(value: str) -> Column:
    return F.expr(f"coalesce(try_cast({value} as map<string, variant>), cast(map() as map<string, variant>))")


def _object(text: Column) -> Column:
    """A JSON object; anything else counts as one without members."""
    read = F.try_parse_json(text)
    return F.when(facts.kind_of(read) == "object", read).otherwise(F.parse_json(F.lit("{}")))


def _number(kind: str, text: str) -> Column:
    """Numbers by value; true and false count as 1 and 0."""
    return F.when(F.col(kind) == "number", F.col(text).cast("double")).when(F.col(kind) == "boolean", (F.col(text) == "true").cast("double"))


def _amount(larger: str, smaller: str) -> Column:
    """larger - smaller of two numbers' texts, exact for whole ones; true and false count as 1 and 0."""
    first, second = (F.when(F.col(c) == "true", "1").when(F.col(c) == "false", "0").otherwise(F.col(c)) for c in (larger, smaller))
    whole = first.rlike(r"^-?\d{1,37}$") & second.rlike(r"^-?\d{1,37}$")
    exact = first.try_cast("decimal(38, 0)") - second.try_cast("decimal(38, 0)")
    return F.when(whole, exact.cast("string")).otherwise((first.try_cast("double") - second.try_cast("double")).cast("string"))


def walked(rows: DataFrame, before: str, after: str, depth: int | None = None) -> DataFrame:
    """``rows`` without the two states but with path, b and a (VARIANTs, null where absent): every place at which not both are objects.

    ``depth`` is how deep objects are opened; by default as deep as any state of ``rows`` goes, which takes a pass over them.
    """
    if depth is None:
        depth = rows.agg(F.greatest(F.max(nesting(F.col(before))), F.max(nesting(F.col(after))))).first()[0] or 0
    kept = [c for c in rows.columns if c not in (before, after)]
    keys = F.array_distinct(F.concat(F.map_keys("__mb"), F.map_keys("__ma")))
    below = F.transform(keys, lambda k: F.struct(F.concat("path", F.array(k)).alias("path"), F.try_element_at("__mb", k).alias("b"), F.try_element_at("__ma", k).alias("a")))
    both = (facts.kind_of(F.col("b")) == "object") & (facts.kind_of(F.col("a")) == "object")
    pairs = rows.select(*kept, F.array().cast("array<string>").alias("path"), _object(F.col(before)).alias("b"), _object(F.col(after)).alias("a"))
    for _ in range(depth):
        opened = pairs.withColumn("__mb", F.when(both, _members("b"))).withColumn("__ma", F.when(both, _members("a")))
        pairs = opened.select(*kept, F.inline(F.when(F.col("__mb").isNull(), F.array(F.struct("path", "b", "a"))).otherwise(below)))
    return pairs.where(~F.coalesce(both, F.lit(False)))


def changes(rows: DataFrame, before: str, after: str, depth: int | None = None) -> DataFrame:
    """``rows`` without the two states (JSON texts) but with steps, path, type, before, after and note: one row per change.

    Objects are compared member by member; an added or removed part is one change. Numbers are equal by value, arrays and unlike kinds
    by their JSON with members in order; a number that grew or shrank has a note. A null, unreadable or other state
    counts as an object without members. Equal states have no rows.
    """
    kept = [c for c in rows.columns if c not in (before, after)]
    met = walked(rows, before, after, depth)
    read = met.select(*kept, F.col("path").alias("steps"), facts.kind_of(F.col("b")).alias("kind_b"), F.to_json("b").alias("text_b"), facts.kind_of(F.col("a")).alias("kind_a"), F.to_json("a").alias("text_a"))
    b, a = _number("kind_b", "text_b"), _number("kind_a", "text_a")
    numbers = b.isNotNull() & a.isNotNull()
    kind = F.when(F.col("kind_b").isNull(), "added").when(F.col("kind_a").isNull(), "removed").when(F.when(numbers, b != a).otherwise(F.col("text_b") != F.col("text_a")), "modified")
    grew = F.when(a > b, F.concat(F.lit("increased by "), _amount("text_a", "text_b"))).when(a < b, F.concat(F.lit("decreased by "), _amount("text_b", "text_a")))
    told = read.withColumn("type", kind).where(F.col("type").isNotNull())
    note = F.when((F.col("type") == "modified") & numbers, grew)
    return told.select(*kept, "steps", F.array_join("steps", ".").alias("path"), "type", F.col("text_b").alias("before"), F.col("text_a").alias("after"), note.alias("note"))


def attach(rows: DataFrame, id_column: str, before: str, after: str, depth: int | None = None) -> DataFrame:
    """``rows`` with ``changes`` (in the order of their paths) and ``change_count``; ``id_column`` must be unique and not null."""
    found = changes(rows.select(id_column, before, after), before, after, depth)
    entry = F.struct("steps", F.struct("path", "type", "before", "after", "note").alias("c"))
    listed = found.groupBy(id_column).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("changes"))
    joined = rows.join(listed, id_column, "left")
    return joined.withColumn("changes", F.coalesce("changes", F.array().cast(CHANGE))).withColumn("change_count", F.size("changes"))


def state_matches(rows: DataFrame, id_column: str, before: str, after: str, predicted: str, depth: int | None = None) -> DataFrame:
    """id, by_path, strict for each row: whether every true change (before to after) stands in the predicted state, and whether the
    predicted state is the true one.

    The first asks only for the true changes' paths, so further wrong changes do not count against it, and a removed part
    counts as found only where the predicted state holds null. States that are no objects count as empty ones.
    ``id_column`` must be unique and not null.
    """
    if depth is None:
        depth = rows.agg(F.greatest(*[F.max(nesting(F.col(c))) for c in (before, after, predicted)])).first()[0] or 0
    true = changes(rows.select(id_column, before, after), before, after, depth).select(id_column, "steps", F.coalesce("after", F.lit("null")).alias("want"))
    held = facts.described(facts.flattened(rows.select(id_column, _object(F.col(predicted)).alias("s")), "s", depth, arrays=False)).select(id_column, F.col("path").alias("steps"), "text", "kind")
    met = true.join(held, [id_column, "steps"], "left").withColumn("want_kind", facts.kind_of(F.try_parse_json("want")))
    numbers = _number("kind", "text"), _number("want_kind", "want")
    same = F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), numbers[0] == numbers[1]).otherwise(F.col("text") == F.col("want"))
    found = met.groupBy(id_column).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("by_path"))
    wrong = changes(rows.select(id_column, after, predicted), after, predicted, depth).select(id_column).distinct().withColumn("wrong", F.lit(True))
    joined = rows.select(id_column).join(found, id_column, "left").join(wrong, id_column, "left")
    return joined.select(id_column, F.coalesce("by_path", F.lit(True)).alias("by_path"), F.col("wrong").isNull().alias("strict"))


def spaced(text: Column) -> Column:
    """JSON text with a space after each comma and colon that is not inside a string."""
    return F.regexp_replace(text, r'((?:"(?:[^"\\]++|\\.)*+"|[^",:])*+[,:])', "$1 ")


def call_text(action: Column) -> Column:
    """name({arguments}) of an action's JSON, members in the order in which they stand."""
    arguments = F.get_json_object(action, "$.arguments")
    return F.concat(F.get_json_object(action, "$.name"), F.lit("("), spaced(F.coalesce(arguments, F.lit("{}"))), F.lit(")"))


def argument_count(action: Column) -> Column:
    arguments = F.get_json_object(action, "$.arguments")
    return F.coalesce(F.size(F.json_object_keys(arguments)), F.json_array_length(arguments), F.lit(0))
