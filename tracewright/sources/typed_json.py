"""Values that JSON lacks, kept through a save: a recursive VARIANT encoding by schema, and its inverse.

Types are written as tagged objects: decimals, timestamps, sets and tuples, and maps whose keys are no texts, numbers or
booleans. Spark has no sets and tuples, so a field whose metadata say ``{"as": "set"}`` or ``{"as": "tuple"}`` is one: an
array (a set is sorted and has each value once) or, for a tuple, a struct or an array. Everything else is written as it is;
plain map keys become the texts that JSON has for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed by the format of saved files.
TAG, ITEMS, VALUE = "__type__", "items", "value"
_PLAIN_KEYS = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType)


def _variant(value: Column) -> Column:
    return F.to_variant_object(value)


def _tagged(tag: str, name: str, value: Column) -> Column:
    return _variant(F.struct(F.lit(tag).alias(TAG), value.alias(name)))


def encoded(value: Column, kind: T.DataType, as_: str | None = None) -> Column:
    """``value`` as a VARIANT in which nothing is lost; null stays null."""
    if isinstance(kind, T.StructType):
        members = [(f, encoded(value.getField(f.name), f.dataType, f.metadata.get("as"))) for f in kind]
        if as_ == "tuple":
            made = _tagged("tuple", ITEMS, F.array(*[m for _, m in members]))
        else:
            made = _variant(F.struct(*[m.alias(f.name) for f, m in members]))
    elif isinstance(kind, T.ArrayType):
        items = F.array_sort(F.array_distinct(value)) if as_ == "set" else value
        items = F.transform(items, lambda x: encoded(x, kind.elementType))
        made = _tagged(as_, ITEMS, items) if as_ in ("set", "tuple") else _variant(items)
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, _PLAIN_KEYS):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), encoded(e["value"], kind.valueType).alias("value")))
        made = _variant(F.map_from_entries(pairs))
    elif isinstance(kind, T.MapType):
        pair = lambda e: _variant(F.array(_tagged("key", VALUE, encoded(e["key"], kind.keyType)), encoded(e["value"], kind.valueType)))
        made = _tagged("dict", ITEMS, F.transform(F.map_entries(value), pair))
    elif isinstance(kind, T.DecimalType):
        made = _tagged("decimal", VALUE, value.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole, part = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(value, "SSSSSS")
        made = _tagged("datetime", VALUE, F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part)))
    else:
        made = value.cast("variant")
    return F.when(value.isNotNull(), made)


def decoded(value: Column, kind: T.DataType, as_: str | None = None) -> Column:
    """The inverse of ``encoded`` for the same schema; a value of another shape is an error."""

    def at(path: str, to: str) -> Column:
        return F.variant_get(value, path, to)

    if isinstance(kind, T.StructType):
        if as_ == "tuple":
            items = at(f"$.{ITEMS}", "array<variant>")
            members = [decoded(F.get(items, F.lit(i)), f.dataType, f.metadata.get("as")).alias(f.name) for i, f in enumerate(kind)]
        else:
            members = [decoded(at(f"$['{f.name}']", "variant"), f.dataType, f.metadata.get("as")).alias(f.name) for f in kind]
        made = F.struct(*members)
    elif isinstance(kind, T.ArrayType):
        made = F.transform(at(f"$.{ITEMS}" if as_ in ("set", "tuple") else "$", "array<variant>"), lambda x: decoded(x, kind.elementType))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, _PLAIN_KEYS):
        pairs = F.map_entries(at("$", "map<string, variant>"))
        made = F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"].cast(kind.keyType), decoded(e["value"], kind.valueType))))
    elif isinstance(kind, T.MapType):
        def pair(e: Column) -> Column:
            both = e.cast("array<variant>")
            return F.struct(decoded(F.variant_get(F.get(both, F.lit(0)), f"$.{VALUE}", "variant"), kind.keyType), decoded(F.get(both, F.lit(1)), kind.valueType))

        made = F.map_from_entries(F.transform(at(f"$.{ITEMS}", "array<variant>"), pair))
    elif isinstance(kind, (T.DecimalType, T.TimestampType, T.TimestampNTZType)):
        made = at(f"$.{VALUE}", "string").cast(kind)
    else:
        made = value.cast(kind)
    return F.when(value.isNotNull() & ~F.is_variant_null(value), made)


def typed_texts(rows: DataFrame) -> DataFrame:
    """record: each row as JSON text that ``typed_rows`` reads back with the same schema."""
    members = [encoded(rows[f"`{f.name}`"], f.dataType, f.metadata.get("as")).alias(f.name) for f in rows.schema]
    return rows.select(F.to_json(_variant(F.struct(*members))).alias("record"))


def typed_rows(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` from the column ``record``; a record that does not read is an error."""
    read = records.select(F.parse_json("record").alias("v"))
    return read.select(decoded(F.col("v"), schema).alias("r")).select("r.*")


def save_typed(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    typed_texts(rows).write.mode(mode).text(path)


def load_typed(rows_path: str, spark, schema: T.StructType) -> DataFrame:
    return typed_rows(spark.read.text(rows_path).select(F.col("value").alias("record")), schema)
