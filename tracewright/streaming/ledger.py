"""Resumable appends without reading the sink again: keys are kept as state, and each micro-batch is an epoch of its own.

The keys that were seen are in the query's state store (RocksDB), so a micro-batch looks up its own keys only, however many rows the
sink holds. An epoch's rows are written to a folder of its own, over whatever an interrupted attempt left there, so a
replay adds nothing. A query with a new checkpoint takes the keys that the sink holds as its initial state, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Lets the first row of each key pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            first = batch.iloc[:1] if first is None and len(batch) else first
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_sink(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a sink of ``append_once``, without the columns that tell runs and epochs."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*[f"`{f.name}`" for f in schema])


def append_once(rows: DataFrame, keys: list[str], path: str, checkpoint: str, run: str) -> StreamingQuery:
    """Append the rows of a stream to Parquet, one per key over all runs; ``run`` names the checkpoint's own part of the sink.

    A null in a key is a value like any other. Which of several new rows of one key stays is the first of them that its task reads.
    A replayed micro-batch overwrites its own epoch; nothing that earlier epochs wrote is read.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    key = F.to_json(F.struct(*[F.col(k).alias(k) for k in keys]), {"ignoreNullFields": "false"})
    known = rows.withColumn("__key", key)
    schema = StructType([*rows.schema.fields])
    initial = None
    if not _exists(spark, f"{checkpoint}/offsets") and _exists(spark, path):
        initial = read_sink(spark, path, schema).select(key.alias("__key")).distinct().groupBy("__key")
    first = known.groupBy("__key").transformWithStateInPandas(statefulProcessor=FirstOfKey(), outputStructType=schema, outputMode="Append", timeMode="None", initialState=initial)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/epoch={epoch}")

    return first.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
