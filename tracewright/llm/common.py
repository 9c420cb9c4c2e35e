"""Shared helpers: written stages, document normalisation and access to the public tokenizer files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a local session without one gets a temporary one (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tracewright-shared-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tracewright/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """Write ``df`` once as a table in buckets of ``key``: later joins on it move the other side only. ``dealt``: its rows are
    few and large, or lie together by ``key`` already, and are written from where they are."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"tracewright_{name}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key)
    rows.write.bucketBy(n, key).option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/tracewright/{table}").saveAsTable(table)
    return spark.table(table)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_by_row(spark: SparkSession):
    """Tables written inside send their rows, each some megabytes large, to Python one at a time."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1")


def small_batches(spark: SparkSession):
    """Tables written inside send rows to Python by some four megabytes: large rows alone, small ones together."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def drop_bucketed(*tables: DataFrame) -> None:
    """Drop tables made by ``bucketed`` that nothing reads any more, with their folders."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            df.sparkSession.sql(f"drop table if exists {folder.rsplit('/', 1)[1]}")
        _delete(df.sparkSession, folders)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the folders of stages that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, folders: set[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        if "/tracewright/" in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and text (and ``others``) alone; a null text becomes an empty one and a row without an id is left out (no result could name it)."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file on this machine; called inside tasks, as every machine has its own copy."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def keep_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, with all columns, that pass a test; ``keep()`` makes the test once per task, and the test maps the
    doc_id and text columns of one Arrow batch to booleans."""
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        chosen = keep()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(chosen(batch.column(at_id), batch.column(at_text)), pa.bool_()))

    return map_rows(docs, run)


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``docs`` through ``run`` in Arrow batches of its columns, which keep their places and types. Columns go by number meanwhile, as
    Spark would read a name with a dot in it as a member."""
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    return docs.toDF(*[f.name for f in fields]).mapInArrow(run, T.StructType(fields)).toDF(*docs.columns)
