"""Keyed stream state with timers: rows that wait for their turn, and state that ends.

These jobs keep their state in RocksDB, as Spark asks for timers; ``use_timers`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """State of streams that start from now on lies in RocksDB."""
    ship(spark)
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def _plain(x: object) -> object:
    """A value as it was before pandas: nulls as None, whole numbers beside nulls as such."""
    if x is None or x is pd.NA or x != x:
        return None
    return int(x) if isinstance(x, float) else x


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    return zip(*([_plain(x) for x in batch[c].tolist()] for c in batch.columns), strict=True)


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of (time, number), whatever the order they come in.

    A row waits until the watermark has passed its time: nothing that may still come stands before
    it. Subclasses name the columns and say what a row does. Their state is one small row.
    """

    WAITING = "time long, number long"  # and more columns of the rows
    STATE = ""
    COLUMNS: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.state = handle.getValueState("state", self.STATE)

    def take(self, key: tuple, state: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        """The state after a row; rows to return are added to ``out``. None ends the state."""
        raise NotImplementedError

    def wake(self, key: tuple, state: tuple, now: int, out: list[tuple]) -> tuple | None:
        """The state after all rows before ``now`` (milliseconds) were taken."""
        return state

    def next_wake(self, state: tuple) -> int | None:
        """When ``wake`` wants to be called again (milliseconds)."""
        return None

    def _advance(self, key: tuple, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        rows.sort(key=lambda r: r[:2])
        ready = [r for r in rows if r[0] // 1000 < now]
        rest = rows[len(ready) :]
        state = before = tuple(self.state.get()) if self.state.exists() else None
        out: list[tuple] = []
        for row in ready:
            state = self.take(key, state, row, out)
        if state is not None:
            state = self.wake(key, state, now, out)
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        if state is None:
            if before is not None:
                self.state.clear()
        elif state != before:
            self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [rest[0][0] // 1000 + 1] if rest else []
        if state is not None and (at := self.next_wake(state)) is not None:
            times.append(at)
        if times:
            self.handle.registerTimer(max(min(times), now + 1))
        if out:
            yield pd.DataFrame(out, columns=list(self.COLUMNS), dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for batch in rows for r in _rows(self.rows_of(batch))]
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        due = min((r[0] // 1000 + 1 for r in new), default=now)
        if due > now:
            timers = list(self.handle.listTimers())
            if all(t > now for t in timers):  # nothing held is ready either: add to it without reading it again
                self.waiting.appendList(new)
                if not timers or due < min(timers):
                    for timer in timers:
                        self.handle.deleteTimer(timer)
                    self.handle.registerTimer(due)
                return
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, held + new, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(key, held, max(timerValues.getCurrentWatermarkInMs(), 0))

    def rows_of(self, batch: pd.DataFrame) -> pd.DataFrame:
        """The columns of ``WAITING``, in its order."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], processor: InOrder, output: str) -> DataFrame:
    """Run a processor over a stream with a watermark."""
    use_timers(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "eventTime")
