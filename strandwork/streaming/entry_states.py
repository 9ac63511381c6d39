"""Entry states kept from a stream of events that may come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandwork.operators import lifecycle

OUT = f"entry string, {lifecycle.STATE}"


class EntryStates(StatefulProcessor):
    """Folds an entry's events in the order of their times.

    Events up to the watermark are settled into one value; later ones wait in a list, as an
    earlier one may still come, and are folded on top of it for what is told now. A timer a day
    after a pending entry's start expires it. An entry's state is the events of one watermark
    delay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", lifecycle.STATE)
        self.open = handle.getListState("open", "at long, event_id long, action string")

    def _told(self, key: tuple, watermark: int) -> tuple:
        state = tuple(self.settled.get()) if self.settled.exists() else lifecycle.FRESH
        waiting = sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []
        for at, _, action in [x for x in waiting if x[0] <= watermark]:
            state = lifecycle.step(state, at, action)
        self.settled.update(state)
        left = [x for x in waiting if x[0] > watermark]
        self.open.clear()
        if left:
            self.open.put(left)
        for at, _, action in left:
            state = lifecycle.step(state, at, action)
        if state[0] == "PENDING":
            if watermark - state[2] > lifecycle.LIFE_MS:
                state = ("EXPIRED", *state[1:])
            else:
                self.handle.registerTimer(state[2] + lifecycle.LIFE_MS + 1)
        return (str(key[0]), *state)

    def _frame(self, row: tuple) -> pd.DataFrame:
        return pd.DataFrame([row], columns=["entry", "status", "test_status", "since", "refused"]).astype({"since": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for x in batch.itertuples(index=False):
                self.open.appendValue((int(x.at), int(x.event_id), "" if x.action is None else str(x.action)))
        yield self._frame(self._told(key, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._frame(self._told(key, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def entry_states(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(entry, status, test_status, since, refused) updates of a stream events(entry, ts, event_id, action).

    ts is a timestamp; rows more than `late` behind the newest are dropped. The last update of an
    entry is what lifecycle.replayed gives over its events, with the watermark for now.
    """
    rows = events.withWatermark("ts", late).select(F.col("entry").cast("string").alias("entry"), "ts", F.unix_millis("ts").alias("at"), "event_id", "action")
    return rows.groupBy("entry").transformWithStateInPandas(EntryStates(), OUT, "Update", "EventTime")
