"""What facts of sources say together: methods and what they use, states and who changes them, verdicts on returns, tool schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.source_facts import source_facts

#: Schema names of simple types.
SIMPLE = "str string int integer list array dict object float number bool boolean object object"
NESTED = 4  # how deep Optional and List are read in a parameter's type


def facts(sources: DataFrame, key: str, source: str) -> DataFrame:
    """key and the facts of each source, in rows; a source that does not parse has none."""
    return sources.select(key, F.inline(source_facts(F.col(source))))


def validity(sources: DataFrame, key: str, source: str) -> DataFrame:
    """key, parses, has_function (at the top level) for every key, also those whose source does not parse."""
    told = facts(sources, key, source).groupBy(key).agg(F.lit(True).alias("parses"), F.bool_or((F.col("kind") == "function") & (F.col("class") == "")).alias("has_function"))
    both = sources.select(key).distinct().join(told, key, "left")
    return both.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("parses", "has_function")])


def type_name(text: Column, shape: Column) -> Column:
    """An annotation's or value's type by its last names; a constant's by its kind; anything else is unknown."""
    constant = F.when(text == "None", "NoneType").when(text.isin("True", "False"), "bool").when(text.rlike(r"^b['\"]"), "bytes").when(text.rlike("^['\"]"), "str").when(text.rlike(r"^\d+$"), "int").when(text == "...", "ellipsis").otherwise("float")
    plain = F.regexp_replace(text, r"\b(?:\w+\.)+(?=[A-Za-z_])", "")
    return F.when(shape == "Constant", constant).when(shape.isin("Name", "Attribute", "Subscript"), plain).when(text.isNotNull(), "unknown")


def default_name(text: Column, shape: Column) -> Column:
    """A default as it is written if it is a constant or a name; of anything longer only what it is."""
    called = F.regexp_extract(text, r"^(?:\w+\.)*(\w+)\(", 1)
    return (
        F.when(shape.isin("Constant", "Name"), text)
        .when(shape == "Call", F.concat(F.when(called == "", "call").otherwise(called), F.lit("(...)")))
        .when(shape == "Dict", "{...}")
        .when(shape == "List", "[...]")
        .when(shape == "Tuple", "(...)")
        .when(shape != "", "...")
    )


def parameters(found: DataFrame, key: str) -> DataFrame:
    """key, class, function, place, name, type, default, kind of every parameter."""
    rows = found.where("kind = 'parameter'")
    default = default_name(F.get("more", F.lit(1)), F.get("more", F.lit(2)))
    return rows.select(key, "class", "function", "place", "name", type_name(F.col("text"), F.col("shape")).alias("type"), default.alias("default"), F.get("more", F.lit(0)).alias("kind"))


def methods(found: DataFrame, key: str) -> DataFrame:
    """key, class, function, returns, doc, source, and sorted names that it calls, reads and writes; ``__init__`` is left out."""
    own = (F.col("class") != "") & ~F.col("function").isin("", "__init__")
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return (
        found.where(own)
        .groupBy(key, "class", "function")
        .agg(
            F.max(F.when(F.col("kind") == "function", type_name(F.col("text"), F.col("shape")))).alias("returns"),
            F.max(F.when(F.col("kind") == "function", F.get("more", F.lit(0)))).alias("doc"),
            F.max(F.when(F.col("kind") == "function", F.get("more", F.lit(1)))).alias("source"),
            names("call").alias("calls"),
            names("read").alias("reads"),
            names("write").alias("writes"),
        )
    )


def states(found: DataFrame, key: str) -> DataFrame:
    """key, class, state, type, used_by, modified_by of every attribute that a class defines, or its methods use.

    Its type is the last annotation, those of ``__init__`` after those of the class body, or else that of the first value.
    """
    own = found.where((F.col("class") != "") & F.col("kind").isin("attribute", "read", "write"))
    told = type_name(F.col("text"), F.col("shape"))
    annotated = F.get("more", F.lit(0)) == "annotated"
    order = F.struct((F.col("function") == "__init__").alias("late"), "place")
    outside = F.col("function") != "__init__"
    users = lambda kind: F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & outside, F.col("function"))))
    grouped = own.groupBy(key, "class", F.col("name").alias("state")).agg(
        F.max_by(F.when(annotated, told), F.when((F.col("kind") == "attribute") & annotated, order)).alias("declared"),
        F.min_by(F.when(~annotated, told), F.when((F.col("kind") == "attribute") & ~annotated, order)).alias("valued"),
        F.bool_or((F.col("kind") == "attribute") | outside).alias("known"),
        users("read").alias("used_by"),
        users("write").alias("modified_by"),
    )
    return grouped.where("known").select(key, "class", "state", F.coalesce("declared", "valued").alias("type"), "used_by", "modified_by")


def returns(found: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key, function, line, status, message: PASS, WARN or FAIL for every return; a literal object should have a ``success`` key."""
    poor = F.lit(strict) & ~F.arrays_overlap("more", F.array(F.lit("data"), F.lit("message"), F.lit("error")))
    verdict = lambda status, message: F.struct(F.lit(status).alias("status"), message.alias("message"))
    status = (
        F.when(F.col("shape").isNull(), verdict("FAIL", F.lit("returns nothing")))
        .when(F.col("shape") == "Name", verdict("WARN", F.concat(F.lit("variable "), "text")))
        .when(F.col("shape") != "Dict", verdict("WARN", F.col("shape")))
        .when(~F.array_contains("more", "success"), verdict("FAIL", F.lit("no success key")))
        .when(poor, verdict("WARN", F.lit("success without data, message or error")))
        .otherwise(verdict("PASS", F.array_join("more", ",")))
    )
    return found.where("kind = 'return'").select(key, "function", F.col("place").alias("line"), status.alias("s")).select(key, "function", "line", "s.status", "s.message")


def _schema(kind: Column, depth: int) -> tuple[Column, Column]:
    """Names of the type (with ``null`` if optional) and the schema of its items, as JSON; beyond ``depth`` a type is an object."""
    words = SIMPLE.split()
    simple = F.create_map(*[F.lit(w) for w in words])
    plain = F.concat(F.lit('"'), F.coalesce(F.try_element_at(simple, kind), F.lit("object")), F.lit('"'))
    if depth == 0:
        return plain, F.lit(None).cast("string")
    inner = F.trim(F.regexp_extract(kind, r"(?s)^(?:Optional|List)\[(.*)\]$", 1))
    types, items = _schema(inner, depth - 1)
    optional, listed = kind.rlike(r"(?s)^Optional\[.*\]$"), kind.rlike(r"(?s)^List\[.*\]$")
    nullable = F.when(types.contains('"null"'), types).otherwise(F.concat(F.lit("["), types, F.lit(', "null"]')))
    return F.when(optional, nullable).when(listed, F.lit('"array"')).when(kind == "Any", F.lit("")).otherwise(plain), F.when(optional, items).when(listed, _object(types, items))


def _object(types: Column, items: Column) -> Column:
    inside = F.concat_ws(", ", F.when(types != "", F.concat(F.lit('"type": '), types)), F.when(items.isNotNull(), F.concat(F.lit('"items": '), items)))
    return F.concat(F.lit("{"), inside, F.lit("}"))


def tool_schemas(given: DataFrame, key: str, descriptions: DataFrame) -> DataFrame:
    """key, function, schema (JSON of a function call) from ``parameters`` rows (without ``self``) and key, function, description.

    A type that is not given counts as an object; parameters whose type is not Optional are required, in their order.
    """
    kind = F.trim(F.coalesce("type", F.lit("object")))
    types, items = _schema(kind, NESTED)
    items = F.when((types == '"array"') & items.isNull(), F.lit("{}")).otherwise(items)
    quoted = F.to_json(F.array("name"))
    name = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    entry = given.where("name <> 'self'").select(key, "function", "place", F.concat(name, F.lit(": "), _object(types, items)).alias("property"), F.when(~kind.rlike(r"(?s)^Optional\[.*\]$"), name).alias("required"))
    listed = entry.groupBy(key, "function").agg(F.array_sort(F.collect_list(F.struct("place", "property", "required"))).alias("e"))
    joined = descriptions.join(listed, [key, "function"], "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<place: int, property: string, required: string>>")))
    properties = F.array_join(F.transform("e", lambda x: x["property"]), ", ")
    required = F.array_join(F.transform("e", lambda x: x["required"]), ", ")
    said = F.to_json(F.struct(F.col("function").alias("name"), F.coalesce("description", F.lit("")).alias("description")))
    head = F.substring(said, F.lit(1), F.length(said) - 1)
    schema = F.concat(F.lit('{"type": "function", "function": '), head, F.lit(', "parameters": {"type": "object", "properties": {'), properties, F.lit('}, "required": ['), required, F.lit("]}}}"))
    return joined.select(key, "function", schema.alias("schema"))
