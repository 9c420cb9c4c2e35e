"""Tables that are evaluated once, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """``spark.checkpoint.dir`` must name a shared folder; a local session without one gets a temporary one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-shared-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    ready(spark)
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return there.rstrip("/")


def checkpointed(rows: DataFrame) -> DataFrame:
    ready(rows.sparkSession)
    return rows.checkpoint()
