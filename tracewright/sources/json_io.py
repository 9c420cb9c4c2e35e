"""JSON, JSON-lines and text sources and sinks of trajectory records.

Records are read as one JSON text per row (column ``record``), so their shape may vary; typed readers take a schema. JSON
lines and arrays split over tasks; a single object is read by one task (2 GB at most).
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators import facts
from tracewright.sources import json_array

WRAPPERS = ("samples", "data", "items")


def formats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, kind of each file in ``path``: ``array``, ``object`` or ``lines``, told by its first line that is not blank.

    That line is a record of ``lines`` if it reads alone and more lines follow, or if it begins neither an array nor an object.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("turn"), F.trim("value").alias("value"))
    heads = lines.where("value <> ''").groupBy("file").agg(F.min_by("value", F.struct("at", "turn")).alias("head"), (F.count("*") > 1).alias("several"))
    first, alone = F.left("head", F.lit(1)), json_array.reads(F.col("head")) & F.col("several")
    return heads.select("file", F.when(alone | ~first.isin("[", "{"), "lines").when(first == "[", "array").otherwise("object").alias("kind"))


def read_records(spark: SparkSession, path: str | list[str], keep_objects_with: tuple[str, ...] = ("trajectory", "step_detail")) -> DataFrame:
    """Records of JSON arrays, single objects and JSON lines; each file of a folder is told apart by its own content.

    A single object counts if it has one of ``keep_objects_with``. A line that is not one whole JSON value is skipped. Arrays may be of
    any size, and a cut one keeps what comes before the cut; an object that does not read whole is an error. Blank files have no records.
    """
    # One row per file, as in Spark's own listing of them.
    files: dict[str, list[str]] = {}
    for r in formats(spark, path).collect():
        files.setdefault(r["kind"], []).append(unquote(r["file"]))
    records = spark.createDataFrame([], "record string")
    if "lines" in files:
        lines = spark.read.text(files["lines"]).select(F.trim("value").alias("record"))
        records = records.union(lines.where(json_array.reads(F.col("record"))))
    if "array" in files:
        records = records.union(json_array.read_array(spark, files["array"]).select("record"))
    if "object" in files:
        whole = spark.read.text(files["object"], wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("record"))
        fails = F.raise_error(F.concat(F.lit("JSON object does not read whole: "), "file"))
        checked = whole.select(F.when(json_array.reads(F.col("record")), F.col("record")).otherwise(fails).alias("record")).withColumn("v", F.parse_json("record"))
        present = F.lit(False)
        for key in keep_objects_with:
            present = present | F.expr(f"variant_get(v, '$.{key}') is not null")
        records = records.union(checked.where(present).select("record"))
    return records


def unwrapped(records: DataFrame) -> DataFrame:
    """Records inside a wrapper, with the record's other columns, place and key: the list under one of WRAPPERS, or the values of an object
    that all have a trajectory, with their keys. Other records stay as they are (place 0, no key); an empty list gives none."""
    others = [c for c in records.columns if c != "record"]
    v = F.col("v")
    lists = F.coalesce(*[F.when(facts.kind_of(x := F.try_variant_get(v, f"$.{k}", "variant")) == "array", x) for k in WRAPPERS])
    values = F.map_values(F.expr("try_cast(v as map<string, variant>)"))
    keyed = (F.size(values) > 0) & F.forall(values, lambda x: F.try_variant_get(x, "$.trajectory", "variant").isNotNull())
    parsed = records.withColumn("v", F.parse_json("record")).withColumn("many", F.coalesce(lists, F.when(keyed, v)))
    plain = parsed.where("many is null").select(*others, F.lit(0).alias("place"), F.lit(None).cast("string").alias("key"), "record")
    wrapped = parsed.where("many is not null").alias("w")
    opened = wrapped.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("w.many").outer()))
    return opened.select(*[f"w.{c}" for c in others], F.col("pos").alias("place"), "key", F.to_json("value").alias("record")).union(plain)


def unwrap(records: DataFrame) -> DataFrame:
    return unwrapped(records.select("record")).select("record")


def read_lines(spark: SparkSession, path: str, schema: str, bad_lines: str = "skip") -> DataFrame:
    """Typed JSON lines; ``bad_lines``: skip, fail, or keep (their text in ``_corrupt_record``)."""
    mode = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[bad_lines]
    if bad_lines == "keep":
        schema = f"{schema}, _corrupt_record string"
    return spark.read.schema(schema).json(path, mode=mode)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed JSON array or object, strict."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _lacking(value: Column, kind: T.DataType) -> Column:
    """Whether a value has a number in it that JSON lacks."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        found = F.isnan(value) | (F.abs(value) == float("inf"))
    elif isinstance(kind, T.StructType):
        found = reduce(or_, [_lacking(value.getField(f.name), f.dataType) for f in kind], F.lit(False))
    elif isinstance(kind, T.ArrayType):
        found = F.exists(value, lambda x: _lacking(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        found = F.exists(F.map_values(value), lambda x: _lacking(x, kind.valueType))
    else:
        return F.lit(False)
    return F.coalesce(found, F.lit(False))


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; a row that holds a number JSON lacks (NaN or infinite), at any depth, is left out."""
    bad = reduce(or_, [_lacking(rows[f"`{f.name}`"], f.dataType) for f in rows.schema], F.lit(False))
    rows.where(~bad).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_lines_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """Typed JSON lines that read, and counts (``lines``, ``bad``) that are there after the first full pass over them, without one of their own."""
    told = Observation("lines read")
    read = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    observed = read.observe(told, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"))
    return observed.where("_corrupt_record is null").drop("_corrupt_record"), told


def write_counted(rows: DataFrame, path: str, env: str, mode: str = "errorifexists") -> dict[str, int]:
    """JSON lines, and the numbers of rows and of environments from the same pass. Environments are a bounded set (some hundreds)."""
    told = Observation("rows written")
    rows.observe(told, F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(env)).alias("environments")).write.mode(mode).json(path)
    return told.get


def write_by_key(rows: DataFrame, key: str, path: str) -> None:
    """A folder per value of ``key``; rows without one are skipped. Rows meet by key first, so a value has few files."""
    rows.where(F.col(key).isNotNull()).repartition(key, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy(key).json(path)


def write_split(rows: DataFrame, test: Column, path: str, names: tuple[str, str] = ("true", "false")) -> None:
    """Two folders by a test (null counts as false) written in one pass; a side without rows gets none."""
    side = F.when(test, names[0]).otherwise(names[1])
    rows.withColumn("side", side).write.partitionBy("side").json(path)


def append_new(rows: DataFrame, path: str, keys: list[str], schema: str) -> None:
    """Append the rows whose keys the sink does not hold yet, so a stopped run can be resumed."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = rows.join(spark.read.schema(schema).json(path).select(*keys).distinct(), keys, "left_anti") if there else rows
    fresh.write.mode("append").json(path)


def write_keys(rows: DataFrame, keys: list[str], path: str) -> None:
    rows.select(*keys).write.csv(path)
