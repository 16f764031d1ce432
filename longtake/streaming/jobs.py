"""Streaming jobs: ingest, demultiplex, status snapshots, following a run."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..session import work_folder

# Events that refresh the status at once, and its shortest interval otherwise.
URGENT_PREFIXES = ["run.", "job.", "stage."]
STATUS_SECONDS = 0.5


def _checkpoint(df: DataFrame) -> str:
    return f"{work_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"


def ingest_events(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (run, seq) once, even when a writer or a file is replayed within the delay.

    Rows that are later than the delay are left out; ``dropped_late`` counts them for a query.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "seq"])


class _LateRows(StreamingQueryListener):
    """Adds up, for the life of every query, the rows left out for coming behind the watermark."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batch: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        query = str(event.progress.id)
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.rows[query] = self.rows.get(query, 0) + late
        self.batch[query] = max(self.batch.get(query, -1), event.progress.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


_LATE: dict[str, _LateRows] = {}


def count_late(spark: SparkSession) -> None:
    """Count late rows of all queries of this session that start from now on; ``start`` does it."""
    application = spark.sparkContext.applicationId
    if application not in _LATE:
        _LATE[application] = _LateRows()
        spark.streams.addListener(_LATE[application])


def dropped_late(query: StreamingQuery, patience: float = 10.0) -> int:
    """Rows that came behind the watermark and were left out, over all batches since the query started here.

    Reports of batches come a little after them; the last one is waited for up to ``patience`` seconds.
    """
    listener = _LATE[query._jsq.sparkSession().sparkContext().applicationId()]
    deadline = time.monotonic() + patience
    last = query.lastProgress
    while last is not None and listener.batch.get(str(query.id), -1) < last.batchId and time.monotonic() < deadline:
        time.sleep(0.05)
    return listener.rows.get(str(query.id), 0)


def start(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    *,
    mode: str = "append",
    every: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Run ``sink`` on every batch; without ``every`` all available input is processed once."""
    count_late(df.sparkSession)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or _checkpoint(df))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.foreachBatch(sink).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """Write every batch under its own id; a batch that is run again replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def run_to_table(df: DataFrame, *, mode: str = "append") -> DataFrame:
    """Process what is available and return the written rows (with their ``batch``)."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/out-{uuid.uuid4().hex}"
    start(df, to_table(path), mode=mode).awaitTermination()
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def latest_update(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every key written by an ``update`` query."""
    values = [c for c in table.columns if c not in (*keys, "batch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def job_events(stream: DataFrame) -> DataFrame:
    """What belongs into a job's own log: its events, but never resource samples."""
    return stream.where(F.col("job_id").isNotNull() & (F.col("type") != "resource.sample"))


def write_job_events(stream: DataFrame, path: str, **options) -> StreamingQuery:
    """Append each event to its job's log, across runs.

    The log of a job is the range of rows with its key: every batch is clustered and sorted by
    job, so a filter on ``job_id`` skips the rest. A folder per job would mean millions of tiny
    files; clustering by (job, run, seq) also splits a job that has most of the events.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        by = ("job_id", "run_id", "seq")
        clustered = batch.repartitionByRange(*by).sortWithinPartitions(*by)
        clustered.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start(job_events(stream), sink, **options)


def job_log(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """All job logs, or the log of one job."""
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return log if job_id is None else log.where(F.col("job_id") == job_id)


def urgent(kind) -> Column:
    out = F.lit(False)
    for prefix in URGENT_PREFIXES:
        out = out | kind.startswith(prefix)
    return out


def snapshots_due(events: DataFrame, seconds: float = STATUS_SECONDS) -> DataFrame:
    """Events after which a status is due: every urgent one, else the first of each interval."""
    tick = F.floor(F.unix_micros("ts") / int(seconds * 1e6))
    flagged = events.withColumn("urgent", urgent(F.col("type"))).withColumn("tick", tick)
    calm = flagged.where(~F.col("urgent")).groupBy("run_id", "tick").agg(F.min("seq").alias("seq"))
    return (
        flagged.where("urgent").select("run_id", "seq").unionByName(calm.select("run_id", "seq"))
    )


def follow(
    stream: DataFrame, run_id: str, path: str, *, every: str = "1 second", timeout: float | None = None
) -> DataFrame:
    """Copy the events of one run until it has finished, then stop.

    A stream that fails or ends before that, and a run that outlasts a given ``timeout``, are
    errors: an incomplete copy is never returned.
    """
    over = threading.Event()
    sink = to_table(path)

    def copy(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch.where(F.col("type") == "run.finished").limit(1).count():
            over.set()

    query = start(stream.where(F.col("run_id") == run_id), copy, every=every)
    deadline = None if timeout is None else time.monotonic() + timeout
    try:
        while not over.wait(0.2):
            if not query.isActive and not over.is_set():
                raise query.exception() or RuntimeError(f"the stream ended before run {run_id} did")
            if deadline is not None and time.monotonic() > deadline:
                raise TimeoutError(f"run {run_id} had not finished after {timeout} seconds")
    finally:
        query.stop()
    return stream.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*")


class SinkRegistry:
    """Named sinks for a batch; one that fails is counted and does not stop the others.

    ``errors`` keeps (batch, message) of every failure, so that the batch can be replayed into it.
    """

    def __init__(self) -> None:
        self.sinks: dict[str, Callable[[DataFrame, int], None]] = {}
        self.failures: dict[str, int] = {}
        self.errors: dict[str, list[tuple[int, str]]] = {}

    def add(self, name: str, sink: Callable[[DataFrame, int], None]) -> None:
        self.sinks[name] = sink
        self.failures.setdefault(name, 0)
        self.errors.setdefault(name, [])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for name, sink in self.sinks.items():
            try:
                sink(batch, batch_id)
            except Exception as problem:
                self.failures[name] += 1
                self.errors[name].append((batch_id, str(problem)))
