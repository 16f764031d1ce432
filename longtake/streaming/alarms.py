"""Live alarms of runs that have gone quiet, and when a status is due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .held import InOrder, in_order, use_timers
from .jobs import STATUS_SECONDS, urgent
from .series import STALL_SECONDS

ALARMS = "run_id string, kind string, seq long, idle_from_us long, at_us long"
_COLUMNS = ("run_id", "kind", "seq", "idle_from_us", "at_us")


class _Replay(InOrder):
    """In event time: (time, number) of the last activity and whether its alarm was raised."""

    WAITING = "time long, number long, finished boolean"
    STATE = "last long, raised boolean"
    COLUMNS = _COLUMNS

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def rows_of(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["at_us", "seq", "finished"]]

    def take(self, key, state, row, out):
        at, seq, finished = row
        if state is not None and at - state[0] >= self.gap:
            if not state[1]:
                out.append((key[0], "raised", None, state[0], state[0] + self.gap))
            out.append((key[0], "cleared", seq, state[0], at))
        return None if finished else (at, False)

    def wake(self, key, state, now, out):
        last, raised = state
        if raised or last + self.gap >= now * 1000:
            return state
        out.append((key[0], "raised", None, last, last + self.gap))
        return (last, True)

    def next_wake(self, state):
        return None if state[1] else (state[0] + self.gap) // 1000 + 1


class _Live(StatefulProcessor):
    """In processing time: the clock starts anew with everything a run does."""

    def __init__(self, gap_us: int, forget_ms: int) -> None:
        self.gap, self.forget = gap_us, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, raised boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["at_us", "seq"])
        last, raised = self.state.get() if self.state.exists() else (None, False)
        first = new.iloc[0]
        if raised:
            yield pd.DataFrame([(key[0], "cleared", first["seq"], last, first["at_us"])], columns=_COLUMNS)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if new.iloc[-1]["finished"]:
            self.state.clear()
            return
        last = int(new["at_us"].max()) if last is None else max(last, int(new["at_us"].max()))
        self.state.update((last, False))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        last, raised = self.state.get()
        if raised:  # nobody has cleared the alarm for long: the run is gone
            self.state.clear()
            return
        self.state.update((last, True))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
        row = (key[0], "raised", None, last, last + self.gap)
        yield pd.DataFrame([row], columns=_COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def stall_alarms(events: DataFrame, gap_seconds: float = STALL_SECONDS, *, live: bool = True, forget_seconds: float = 86_400) -> DataFrame:
    """A row when a running run has been quiet for the gap, and one when it goes on.

    Resource samples are no activity; a finished run is never late. ``kind`` is ``raised`` or
    ``cleared``; ``idle_from`` is the last activity, ``at`` when the alarm was due or the event that
    cleared it, with its ``seq``. ``live`` alarms follow the clock, and a run that stays quiet for
    ``forget_seconds`` more leaves the state. Otherwise they follow the watermark of the stream:
    events are taken in the order of their time, so a replay gives the same rows in any order of arrival.
    State is one small row per run that has not finished, and the events behind the watermark.
    """
    active = events.where(F.col("type") != "resource.sample")
    slim = active.select("run_id", "seq", "ts", F.unix_micros("ts").alias("at_us"), (F.col("type") == "run.finished").alias("finished"))
    gap = int(gap_seconds * 1_000_000)
    if live:
        use_timers(events.sparkSession)
        processor = _Live(gap, int(forget_seconds * 1000))
        found = slim.groupBy("run_id").transformWithStateInPandas(processor, ALARMS, "append", "processingTime")
    else:
        found = in_order(slim, ["run_id"], _Replay(gap), ALARMS)
    time = lambda c: F.timestamp_micros(c)
    return found.select("run_id", "kind", "seq", time("idle_from_us").alias("idle_from"), time("at_us").alias("at"))


class _Cadence(InOrder):
    """(time of the last write): urgent events write at once, others when the interval has passed."""

    WAITING = "time long, number long, urgent boolean"
    STATE = "written long"
    COLUMNS = ("run_id", "seq", "at_us")

    def __init__(self, interval_us: int) -> None:
        self.interval = interval_us

    def rows_of(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["at_us", "seq", "urgent"]]

    def take(self, key, state, row, out):
        at, seq, is_urgent = row
        if state is not None and not is_urgent and at - state[0] < self.interval:
            return state
        out.append((key[0], seq, at))
        return (at,)


def status_writes(events: DataFrame, seconds: float = STATUS_SECONDS) -> DataFrame:
    """(run_id, seq, at) of the events that a status is written for, over a stream with a watermark.

    Each interval begins with the write before it, so the events of a run are taken in order.
    """
    slim = events.select("run_id", "seq", "ts", F.unix_micros("ts").alias("at_us"), urgent(F.col("type")).alias("urgent"))
    found = in_order(slim, ["run_id"], _Cadence(int(seconds * 1_000_000)), "run_id string, seq long, at_us long")
    return found.select("run_id", "seq", F.timestamp_micros("at_us").alias("at"))
