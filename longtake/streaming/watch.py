"""Files that have stopped changing: ready to process, retried, or given up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import neighbours, running
from ..session import stage
from .held import InOrder, in_order

SCAN_BLOCK = 1 << 16
SUCCESS = ["completed", "skipped", "prepared"]


def stable_files(
    observations: DataFrame, results: DataFrame | None, *, stable_scans: int = 2, retries: int = 2
) -> DataFrame:
    """Every observation with its stable count and whether the file is ready.

    ``observations(path, scan, size, mtime)``, one per scan that saw the file;
    ``results(path, scan, status)`` of files processed after that scan.
    """
    limit = retries + 1
    block = F.floor(F.col("scan") / SCAN_BLOCK)
    if results is None:
        tagged = observations.withColumn("status", F.lit(None).cast("string"))
    else:
        # As many as the observations where every scan has a result: too many to be sent to every task.
        tagged = observations.join(results.select("path", "scan", "status").hint("merge"), ["path", "scan"], "left")
    seen = neighbours(
        tagged, ["path"], ["scan"], block,
        before={"p_scan": F.col("scan"), "p_size": F.col("size"), "p_mtime": F.col("mtime")},
    )
    same = (F.col("p_size") == F.col("size")) & (F.col("p_mtime") == F.col("mtime"))
    changed = ~F.coalesce(same, F.lit(False))
    won = F.when(F.col("status").isin(SUCCESS), 1).otherwise(0).cast("long")
    breaks = changed | (F.col("p_scan") != F.col("scan") - 1)
    islands = stage(
        running(
            seen, ["path"], ["scan"], block,
            {
                "stable_from": ("max", F.when(breaks, F.col("scan"))),
                "signature_from": ("max", F.when(changed, F.col("scan"))),
                "wins": ("sum", won),
            },
        ).select(
            "path", "scan", "size", "mtime", "status", "stable_from", "signature_from",
            (F.col("wins") - won).alias("wins"),
        )
    )
    bad = F.when(F.col("status").isNotNull() & ~F.col("status").isin(SUCCESS), 1).otherwise(0).cast("long")
    counted = stage(
        running(
            islands, ["path", "signature_from", "wins"], ["scan"], block, {"failures": ("sum", bad)}
        ).withColumn("failed_here", bad)
    )
    over = F.col("status").isin(SUCCESS) | ((F.col("failed_here") == 1) & (F.col("failures") >= limit))
    settled = running(
        counted, ["path"], ["scan"], block,
        {"settled": ("last", F.when(over, F.struct("size", "mtime")))},
        exclusive=True,
    )
    count = F.col("scan") - F.col("stable_from") + 1
    before = F.col("failures") - F.col("failed_here")
    again = F.col("settled").isNotNull() & (F.col("settled.size") == F.col("size")) & (F.col("settled.mtime") == F.col("mtime"))
    return settled.select(
        "path",
        "scan",
        count.alias("stable_count"),
        before.alias("failures_before"),
        ((count >= stable_scans) & ~again & (before < limit)).alias("ready"),
    )


_STATE = (
    "scan long, size long, mtime long, count long, done_size long, done_mtime long, "
    "try_size long, try_mtime long, tries long"
)


_UNSEEN = (-9, -1, -1, 0, -1, -1, -1, -1, 0)


def _answer(seen: tuple, row: tuple, stable_scans: int, limit: int) -> tuple[tuple, tuple]:
    """What is known of a path after one more scan, and (stable_count, failures_before, ready) of that scan."""
    scan, size, mtime, count, ds, dm, ts, tm, tries = seen
    number, own_size, own_mtime, status = row
    known = own_size == size and own_mtime == mtime
    count = count + 1 if known and number == scan + 1 else 1
    if (ts, tm) != (own_size, own_mtime):
        ts, tm, tries = own_size, own_mtime, 0
    answer = count, tries, count >= stable_scans and (ds, dm) != (own_size, own_mtime) and tries < limit
    if status in SUCCESS:
        ds, dm, tries = own_size, own_mtime, 0
    elif status is not None:
        tries += 1
        if tries >= limit:
            ds, dm = own_size, own_mtime
    return tuple(int(x) for x in (number, own_size, own_mtime, count, ds, dm, ts, tm, tries)), answer


def _watch(stable_scans: int, limit: int, forget: int | None):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("scan")
        scan, size, mtime, count, ds, dm, ts, tm, tries = (
            state.get if state.exists else _UNSEEN
        )
        out = []
        for row in rows.itertuples():
            if row.scan <= scan:  # behind a scan that has been answered: no count can be right now
                out.append((key[0], row.scan, None, None, False))
                continue
            seen = (scan, size, mtime, count, ds, dm, ts, tm, tries)
            seen, answer = _answer(seen, (row.scan, row.size_, row.mtime, row.status), stable_scans, limit)
            scan, size, mtime, count, ds, dm, ts, tm, tries = seen
            out.append((key[0], row.scan, *answer))
        state.update(tuple(int(x) for x in (scan, size, mtime, count, ds, dm, ts, tm, tries)))
        if forget is not None:
            state.setTimeoutDuration(forget)
        columns = ["path", "scan", "stable_count", "failures_before", "ready"]
        yield pd.DataFrame(out, columns=columns).astype({"stable_count": "Int64", "failures_before": "Int64"})

    return step


def stable_files_stream(
    observations: DataFrame, *, stable_scans: int = 2, retries: int = 2, forget_days: float | None = None
) -> DataFrame:
    """The same over a stream of ``(path, scan, size, mtime, status)``; scans arrive in order.

    A scan that arrives after a later one of its path comes out without counts and changes nothing.
    The state of a path is one small row, dropped when nothing was seen of it for ``forget_days``;
    such a stream wakes up for its timeouts, so it never runs out as ``availableNow`` asks for.
    A batch of one path holds only the scans since the last trigger.
    """
    kind = observations.schema["path"].dataType.simpleString()
    result = f"path {kind}, scan long, stable_count long, failures_before long, ready boolean"
    lasting = forget_days is None
    step = _watch(stable_scans, retries + 1, None if lasting else int(forget_days * 86_400_000))
    timeout = GroupStateTimeout.NoTimeout if lasting else GroupStateTimeout.ProcessingTimeTimeout
    named = observations.select("path", "scan", F.col("size").alias("size_"), "mtime", "status")
    return named.groupBy("path").applyInPandasWithState(
        step, result, _STATE, "append", timeout
    )


class _Ordered(InOrder):
    """Scans of a path in the order of their time; those that come late wait for nothing any more."""

    WAITING = "time long, number long, size long, mtime long, status string"
    STATE = _STATE + ", at long"
    COLUMNS = ("path", "scan", "stable_count", "failures_before", "ready")

    def __init__(self, stable_scans: int, limit: int, forget_us: int | None) -> None:
        self.stable_scans, self.limit, self.forget = stable_scans, limit, forget_us

    def rows_of(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["at", "scan", "size_", "mtime", "status"]]

    def take(self, key, state, row, out):
        at, number, size, mtime, status = row
        seen, answer = _answer(_UNSEEN if state is None else state[:-1], (number, size, mtime, status), self.stable_scans, self.limit)
        out.append((key[0], number, *answer))
        return (*seen, at)

    def wake(self, key, state, now, out):
        return None if self.forget is not None and state[-1] + self.forget < now * 1000 else state

    def next_wake(self, state):
        return None if self.forget is None else (state[-1] + self.forget) // 1000 + 1


def stable_files_in_order(
    observations: DataFrame, *, stable_scans: int = 2, retries: int = 2, forget_days: float | None = None
) -> DataFrame:
    """The same over a stream ``(path, ts, scan, size, mtime, status)`` with a watermark on ``ts``, in any order.

    Scans wait until the watermark has passed their time and are then answered in order, so every
    scan within the watermark's delay gets the answer that the table form gives. A path holds one
    small row and its waiting scans; it is forgotten ``forget_days`` after its last scan.
    """
    kind = observations.schema["path"].dataType.simpleString()
    named = observations.select("path", "scan", F.col("size").alias("size_"), "mtime", "status", "ts", F.unix_micros("ts").alias("at"))
    forget = None if forget_days is None else int(forget_days * 86_400_000_000)
    processor = _Ordered(stable_scans, retries + 1, forget)
    return in_order(named, ["path"], processor, f"path {kind}, scan long, stable_count long, failures_before long, ready boolean")
