"""A stateful fold over a stream of steps: the state before and after each step, its changes, late steps, and the end of trajectories.

``transformWithState`` keeps one value per trajectory (its last position and known state) in RocksDB, so memory and the cost of a
micro-batch follow the batch, not the trajectories that were ever seen. A trajectory ends with a step that says so, or when no step
has come for ``idle``; its state is removed then, and a last row tells so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewright.functions import jsonx

STEPS = "trajectory long, position long, outcome string, state_before string, state_after string, changes string, change_count int"
CHANGE = "array<struct<path: string, type: string, before: string, after: string, note: string>>"


def _read(text: str | None):
    found = None if text is None else jsonx.first_that_reads(text, json.loads)
    return None if found is jsonx.ABSENT else found


def changes_text(before: str | None, after: str | None) -> tuple[str, int]:
    """The ordered changes between two states as JSON, and their number."""
    found = [
        {"path": p, "type": t, "before": jsonx.dumps(b), "after": jsonx.dumps(a), "note": n} if t == "modified" else {"path": p, "type": t, "before": None if b is None else jsonx.dumps(b), "after": None if a is None else jsonx.dumps(a), "note": n}
        for p, t, b, a, n in jsonx.changes(_read(before), _read(after), True)
    ]
    return jsonx.dumps(found), len(found)


class StepFold(StatefulProcessor):
    """Rows of ``outcome``: ``step``; ``late`` for a step at or before one that was seen (it changes nothing); ``ended`` or ``expired``
    once for a trajectory that is over, after which the same key begins anew."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "position long, state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        position, state = self.seen.get() if self.seen.exists() else (None, None)
        for row in sorted(rows, key=lambda r: r["position"]):
            if position is not None and row["position"] <= position:
                yield self._row(key[0], row["position"], "late", None, None)
                continue
            before, position = state, row["position"]
            state = before if row["state"] is None else row["state"]
            yield self._row(key[0], position, "step", before, state)
            if row["done"]:
                yield self._row(key[0], position, "ended", state, state)
                position, state = None, None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if position is None:
            self.seen.clear()
        else:
            self.seen.update((position, state))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            position, state = self.seen.get()
            self.seen.clear()
            yield self._row(key[0], position, "expired", state, state)

    @staticmethod
    def _row(trajectory: int, position: int, outcome: str, before: str | None, after: str | None) -> Row:
        changes, n = changes_text(before, after)
        return Row(trajectory=trajectory, position=position, outcome=outcome, state_before=before, state_after=after, changes=changes, change_count=n)

    def close(self) -> None:
        pass


def fold_steps(steps: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """``steps`` streams trajectory, position, state (JSON text or null) and done. Rows without a trajectory or position are left out."""
    spark = steps.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = steps.where("trajectory is not null and position is not null").select("trajectory", "position", "state", "done")
    return known.groupBy("trajectory").transformWithState(statefulProcessor=StepFold(idle_ms), outputStructType=STEPS, outputMode="Append", timeMode="processingTime")
