"""Streaming forms: state carried per trajectory, routing by key, and resumable appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "trajectory long, position long, state_before string, state_after string"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("position")
    before, after = [], []
    for own in rows["state"]:
        before.append(known)
        known = own if own is not None and not pd.isna(own) else known
        after.append(known)
    state.update((known,))
    yield pd.DataFrame({"trajectory": key[0], "position": rows["position"].to_numpy(), "state_before": before, "state_after": after})


def carry_forward(steps: DataFrame) -> DataFrame:
    """``steps`` streams trajectory, position and state. The last known state of each trajectory is kept between
    micro-batches; a step of a later batch must not stand before one of an earlier batch."""
    return steps.groupBy("trajectory").applyInPandasWithState(_carry, STEPS, "known string", "append", GroupStateTimeout.NoTimeout)


def route(rows: DataFrame, key: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows to a folder per value of ``key`` as they arrive; rows without one are skipped."""
    return rows.where(f"{key} is not null").writeStream.partitionBy(key).format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_unseen(rows: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's rows whose keys the Parquet sink does not hold; replayed batches add nothing."""

    def put(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
