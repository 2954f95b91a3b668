"""The state of sources as a stream: what their polls have added up to.

The event log (name, at, calls, ok, error), one row a poll in order of time, is folded by a
keyed state with a timer for midnight UTC, when a day's quota starts anew.  ``folded`` is
the same over a whole log in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.budget import failure_streaks, next_midnight

POLL = "name string, at timestamp, calls long, ok boolean, error string"
STATE = "name string, at timestamp, calls_today long, quota_reset_at timestamp, last_success_at timestamp, last_error string, consecutive_failures long"
_VALUE = "at timestamp, calls_today long, quota_reset_at timestamp, last_success_at timestamp, last_error string, consecutive_failures long"
_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def _midnight_after(at: datetime) -> datetime:
    return datetime(at.year, at.month, at.day) + timedelta(days=1)


def _none(v):
    """Pandas' missing values as None."""
    return None if v is None or v is pd.NaT or v != v else v


def fold(state: tuple | None, at: datetime, calls: int, ok: bool, error: str | None) -> tuple:
    """The state after a poll: a new day counts anew, a success ends the failures."""
    _, today, reset, success, _, failures = state or (None, 0, datetime.min, None, None, 0)
    over = at >= reset
    return at, (0 if over else today) + calls, _midnight_after(at) if over else reset, at if ok else success, None if ok else error, 0 if ok else failures + 1


class SourceState(StatefulProcessor):
    """Emits a source's state after each micro-batch with polls of it, and when its day ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _VALUE)

    def _row(self, key, state: tuple) -> pd.DataFrame:
        row = pd.DataFrame([(key[0], *state)], columns=_COLUMNS)
        return row.astype({c: "datetime64[us]" for c in ("at", "quota_reset_at", "last_success_at")})

    def _get(self) -> tuple | None:
        if not self.state.exists():
            return None
        plain = [_none(v) for v in self.state.get()]
        return tuple(v.replace(tzinfo=None) if isinstance(v, datetime) else v for v in plain)

    def _put(self, before: tuple | None, after: tuple) -> None:
        self.state.update(after)
        if before is None or before[2] != after[2]:
            if before is not None:
                self.handle.deleteTimer(_millis(before[2]))
            self.handle.registerTimer(_millis(after[2]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("at", kind="stable")
        before = state = self._get()
        for at, calls, ok, error in zip(polls["at"], polls["calls"], polls["ok"], polls["error"], strict=True):
            state = fold(state, at.to_pydatetime().replace(tzinfo=None), int(calls), bool(ok), _none(error))
        self._put(before, state)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._get()
        if state is None:
            return
        after = (state[0], 0, state[2] + timedelta(days=1), *state[3:])
        self._put(None, after)
        yield self._row(key, after)

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return int((at - datetime(1970, 1, 1)) / timedelta(milliseconds=1))


def states(polls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream of states (STATE) of a stream of polls (POLL), to be written in update mode.

    A day's end is seen when polls of any source are ``late`` beyond it.  State is a few
    numbers per source.  Needs the RocksDB state store and a session in UTC."""
    return (
        polls.withWatermark("at", late).groupBy("name")
        .transformWithStateInPandas(statefulProcessor=SourceState(), outputStructType=STATE, outputMode="Update", timeMode="EventTime")
    )


def histories(polls: DataFrame) -> DataFrame:
    """STATE after every poll of a log: each row's event, and what has added up to it."""
    order = ["at", "calls", "ok", "error"]
    day = Window.partitionBy("name", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = failure_streaks(polls.withColumn("day", F.date_trunc("day", "at")), "name", order, ~F.col("ok"))
    return x.select(
        *(c for c in polls.columns if c not in ("name", "at", "calls", "ok", "error")), "name", "at", F.sum("calls").over(day).alias("calls_today"), next_midnight(F.col("at")).alias("quota_reset_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).over(past).alias("last_success_at"), F.when(~F.col("ok"), F.col("error")).alias("last_error"), F.col("streak").alias("consecutive_failures"),
    )


def folded(polls: DataFrame) -> DataFrame:
    """The last state of every source in a log, by aggregates that are merged before the
    shuffle: a source's polls don't meet in one task."""
    ok, at = F.col("ok"), F.col("at")
    order = F.struct("at", "calls", "ok", "error")
    last = polls.groupBy("name").agg(F.max("at").alias("at"), F.max(F.when(ok, at)).alias("last_success_at"), F.max_by("ok", order).alias("_ok"), F.max_by("error", order).alias("_error"), F.max(F.when(ok, order)).alias("_success"))
    # counted against a source's last day and last success
    x = polls.join(last.select("name", F.col("at").alias("_at"), "_success"), "name")
    since = x.groupBy("name").agg(
        F.sum(F.when(F.date_trunc("day", "at") == F.date_trunc("day", "_at"), F.col("calls")).otherwise(0)).alias("calls_today"),
        F.count_if(~ok & F.coalesce(F.struct("at", "calls", "ok", "error") > F.col("_success"), F.lit(True))).alias("consecutive_failures"),
    )
    return last.join(since, "name").select("name", "at", "calls_today", next_midnight(F.col("at")).alias("quota_reset_at"), "last_success_at", F.when(~F.col("_ok"), F.col("_error")).alias("last_error"), "consecutive_failures")
