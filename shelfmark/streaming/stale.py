"""Streaming work claims: a running claim older than the limit may be taken again."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.publish import STALE_AFTER

OUTPUT = T.StructType([
    T.StructField("subject", T.StringType()), T.StructField("event", T.StringType())])
_STATE = T.StructType([
    T.StructField("arrival", T.LongType()), T.StructField("status", T.StringType())])


class ClaimWatch(StatefulProcessor):
    """Emit `stale` for a subject whose `running` row is not followed by an end in time."""

    def __init__(self, stale_ms: int = int(STALE_AFTER.total_seconds() * 1000)) -> None:
        self._stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("status", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        # The newest row over all batches and over what earlier micro-batches brought.
        arrival, status = self._state.get() if self._state.exists() else (None, None)
        for batch in rows:
            at = int(batch["arrival"].max())
            if arrival is None or at >= arrival:
                arrival, status = at, batch.loc[batch["arrival"] == at, "status"].iloc[-1]
        for timer in self._handle.listTimers():
            self._handle.deleteTimer(timer)
        self._state.update((arrival, status))
        if status == "running":
            self._handle.registerTimer(
                timerValues.getCurrentProcessingTimeInMs() + self._stale_ms)
        yield pd.DataFrame({"subject": [key[0]], "event": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._state.clear()
        yield pd.DataFrame({"subject": [key[0]], "event": ["stale"]})

    def close(self) -> None:
        pass


def watch_claims(states: DataFrame, stale_ms: int | None = None) -> DataFrame:
    """`states` is a stream of (subject, arrival, status)."""
    watch = ClaimWatch() if stale_ms is None else ClaimWatch(stale_ms)
    return states.groupBy("subject").transformWithStateInPandas(
        watch, OUTPUT, "append", "processingTime")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
