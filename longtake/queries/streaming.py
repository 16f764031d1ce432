"""Queries for sources, streams and series."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..plans import views
from ..schemas import RESOURCE_KEYS
from ..session import work_folder, stage
from ..sources import events as event_source
from ..sources import media, state
from ..streaming import alarms, fold, jobs, series, tables, watch
from .base import EVENTS, MEDIA, OBSERVATIONS, RUN_EVENTS, Book, rounded

BOOK = Book()

SUFFIX_LIST = ", ".join(f"'{x}'" for x in media.SUFFIXES)


@BOOK.add(
    "WITH "
    + MEDIA
    + f""" SELECT page_id, path, length FROM media WHERE lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ({SUFFIX_LIST})
AND len(list_filter(string_split(path, '/'), lambda p: p LIKE '.%' OR p IN ('.git', 'process', 'output'))) = 0"""
)
def src_1_filter_media(spark, sf):
    return media.filter_media(views.media(spark, sf))


def _log_lines(spark, sf):
    """The event log as JSON lines, with broken lines among them."""
    good = event_source.event_lines(views.run_event_log(spark, sf))
    broken = views.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", '{"type": 5, "seq": 1}').otherwise('{"type": "lo').alias("value")
    )
    path = f"{work_folder(spark)}/log-{uuid.uuid4().hex}"
    good.unionByName(broken).write.text(path)
    return path


_LOG = "WITH " + RUN_EVENTS + " SELECT run_id, seq, type, job_id::VARCHAR AS job_id, k % 10 AS idx FROM run_events"


@BOOK.add(_LOG)
def src_2_read_events(spark, sf):
    return _slim(event_source.read_events(spark, _log_lines(spark, sf)))


@BOOK.add(_LOG + " WHERE type LIKE 'chunk.%'")
def src_2_read_events_stream(spark, sf):
    stream = event_source.read_events(
        spark, _log_lines(spark, sf), "chunk.", stream=True, files_per_trigger=4
    )
    return _slim(jobs.run_to_table(stream))


@BOOK.add(_LOG)
def src_2_growing_log_stream(spark, sf):
    """A log read in two runs of one query while it grows; every file ends in a line without its newline."""

    def open_ended(batches):
        for batch in batches:
            yield batch.assign(value=batch["value"] + "\n")
        yield pd.DataFrame({"value": ['{"schema_version": 1, "seq": -1, "type": "unfinished"}']})

    folder = f"{work_folder(spark)}/growing-{uuid.uuid4().hex}"
    lines = spark.read.text(_log_lines(spark, sf))
    early = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    checkpoint, path = f"{folder}/_progress", f"{folder}/_out"
    for i, half in enumerate((early, ~early)):
        lines.where(half).mapInPandas(open_ended, "value string").write.option("lineSep", " ").text(f"{folder}/part={i}")
        stream = event_source.read_events(spark, folder, stream=True, growing=True)
        jobs.start(stream, jobs.to_table(path), checkpoint=checkpoint).awaitTermination()
    return _slim(spark.read.option("basePath", path).parquet(f"{path}/batch=*"))


def _slim(events):
    return events.select(
        "run_id", "seq", "type", "job_id", F.get_json_object("data", "$.index").cast("int").alias("idx")
    )


@BOOK.add(
    """SELECT conv_id AS job_id, turn AS chunk_idx, 1 AS segments, text FROM conversations"""
)
def src_3_read_state(spark, sf):
    turn = F.col("turn")
    documents = views.table(spark, sf, "conversations").select(
        F.to_json(
            F.struct(
                F.col("conv_id").alias("job_id"),
                F.lit("f").alias("fingerprint"),
                F.create_map(
                    turn.cast("string"),
                    F.array(F.struct(turn.cast("double").alias("start"), (turn + 1.0).alias("end"), "text")),
                ).alias("chunks"),
            )
        ).alias("value")
    )
    broken = views.table(spark, sf, "conversations").select(F.col("text").alias("value"))
    path = f"{work_folder(spark)}/state-{uuid.uuid4().hex}"
    documents.unionByName(broken).write.text(path)
    found = state.read_state(spark, path, state.CHECKPOINT, multi_line=False)
    return state.done_chunks(found).select(
        "job_id", "chunk_idx", F.size("segments").alias("segments"), F.col("segments")[0]["text"].alias("text")
    )


@BOOK.add("WITH " + RUN_EVENTS + " SELECT run_id, seq, type FROM run_events")
def str_1_ingest(spark, sf):
    """Every file of the log twice; each event comes out once."""
    once = views.run_event_files(spark, sf)
    doubled = once.unionByName(once).repartition(8, "run_id")
    stream = views.stream_of(stage(doubled), 8)
    return jobs.run_to_table(jobs.ingest_events(stream, "60 days")).select("run_id", "seq", "type")


STATE = """h AS (
  SELECT run_id, max(seq) AS last_seq, max(elapsed_s) AS elapsed_s, max(seq) FILTER (WHERE type = 'job.started') AS job_seq,
    arg_max(k, seq) FILTER (WHERE type = 'run.started') AS rk, arg_max(job_id, seq) FILTER (WHERE type = 'job.started') AS cj,
    count(*) FILTER (WHERE type = 'job.started') AS js, count(*) FILTER (WHERE type = 'job.finished') AS jf,
    max(seq) FILTER (WHERE type = 'job.finished') AS jfs, arg_max(k, seq) FILTER (WHERE type = 'job.finished') AS jk,
    count(*) FILTER (WHERE type IN ('log', 'warning') AND k % 2 = 1) AS warnings, bool_or(type = 'run.finished') AS fin,
    arg_max(k, seq) FILTER (WHERE type = 'run.finished') AS fk FROM run_events GROUP BY run_id),
st AS (
  SELECT e.run_id, k % 4 AS stage, max(seq) FILTER (WHERE type = 'stage.started') AS b, max(seq) FILTER (WHERE type = 'stage.finished') AS f,
    arg_max(value, seq) FILTER (WHERE type = 'stage.finished') AS seconds
  FROM run_events e JOIN h ON h.run_id = e.run_id AND e.seq > h.job_seq WHERE type IN ('stage.started', 'stage.finished') GROUP BY ALL),
cur AS (SELECT s.run_id, s.stage FROM st s JOIN h USING (run_id)
  WHERE b = (SELECT max(b) FROM st x WHERE x.run_id = s.run_id) AND (f IS NULL OR f < b) AND (jfs IS NULL OR jfs < b))"""

_STATE_SQL = (
    "WITH "
    + RUN_EVENTS
    + ", "
    + STATE
    + """ SELECT h.run_id, CASE WHEN fin THEN 'finished' ELSE 'running' END AS state, last_seq, elapsed_s, 'model-' || rk AS model, cj::VARCHAR AS current_job,
  CASE WHEN job_seq IS NOT NULL THEN CASE WHEN jfs > job_seq THEN CASE WHEN jk % 3 = 0 THEN 'failed' ELSE 'completed' END ELSE 'running' END END AS job_status,
  ['probe', 'preparation', 'inference', 'export'][cur.stage + 1] AS current_stage, js AS jobs_started, jf AS jobs_finished, warnings, (fk % 2)::VARCHAR AS exit_status
FROM h LEFT JOIN cur USING (run_id)"""
)


def _state(headers, stages):
    return fold.run_state(headers, stages).select(
        "run_id", "state", "last_seq", "elapsed_s", "model", "current_job", "job_status", "current_stage",
        "jobs_started", "jobs_finished", "warnings", "exit_status",
    )


@BOOK.add(_STATE_SQL)
def str_2_run_state(spark, sf):
    events = views.run_event_files(spark, sf)
    return _state(stage(fold.run_headers(events)), fold.run_stages(events))


@BOOK.add(_STATE_SQL)
def str_2_run_state_stream(spark, sf):
    """From state tables that finished runs have left; runs of all days are one after the other."""
    stream = views.stream_of(views.run_event_files(spark, sf))
    headers, stages = (_folded(spark, stream, f).everything(spark) for f in (fold.header_fold(), fold.stage_fold()))
    return _state(stage(headers), stages)


def _folded(spark, stream, what, **times):
    state_table = tables.StateTable(f"{work_folder(spark)}/state-{uuid.uuid4().hex}", what, **times)
    state_table.run(stream).awaitTermination()
    return state_table


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + ", "
    + STATE
    + " SELECT run_id, ['probe', 'preparation', 'inference', 'export'][stage + 1] AS stage, CASE WHEN b IS NOT NULL AND (f IS NULL OR b > f) THEN 'running' ELSE 'done' END AS state, seconds FROM st"
)
def str_2_stage_states(spark, sf):
    events = views.run_event_files(spark, sf)
    return fold.stage_states(fold.run_headers(events), fold.run_stages(events)).select("run_id", "stage", "state", "seconds")


@BOOK.add(
    "WITH " + RUN_EVENTS + " SELECT run_id, seq, job_id::VARCHAR AS job_id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM run_events WHERE type = 'job.finished'"
)
def str_2_finished_jobs(spark, sf):
    return fold.finished_jobs(views.run_event_files(spark, sf)).drop("error")


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + """, l AS (SELECT run_id, seq, CASE WHEN k % 2 = 0 THEN 'info' ELSE 'error' END AS level, event_type AS text, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r
  FROM run_events WHERE type IN ('log', 'warning')) SELECT run_id, seq, level, text FROM l WHERE r <= 40"""
)
def win_14_recent_activity(spark, sf):
    return fold.recent_activity(views.run_event_files(spark, sf))


MAP = (
    "WITH "
    + RUN_EVENTS
    + """, p AS (SELECT run_id, max(seq) AS ps, arg_max(k % 7 + 6, seq) AS planned FROM run_events WHERE type = 'job.prepared' GROUP BY run_id),
m AS (SELECT run_id, k % 10 AS i, max(seq) AS ms, arg_max(CASE WHEN type = 'chunk.started' THEN 'a' WHEN k % 3 = 0 THEN 'o' WHEN k % 3 = 1 THEN 's' ELSE 'f' END, seq) AS mark
  FROM run_events WHERE type IN ('chunk.started', 'chunk.finished') GROUP BY ALL),
g AS (SELECT run_id, ps, unnest(range(0, planned)) AS i FROM p)
SELECT g.run_id, 0::BIGINT AS part_no, string_agg(CASE WHEN m.ms > g.ps THEN m.mark ELSE '.' END, '' ORDER BY g.i) AS marks FROM g LEFT JOIN m USING (run_id, i) GROUP BY g.run_id"""
)


@BOOK.add(MAP)
def str_3_chunk_map(spark, sf):
    events = views.run_event_files(spark, sf)
    return fold.chunk_map(fold.plans(events), fold.chunk_marks(events))


@BOOK.add(MAP)
def str_3_chunk_map_stream(spark, sf):
    stream = views.stream_of(views.run_event_files(spark, sf))
    plans, marks = (_folded(spark, stream, f).everything(spark) for f in (fold.plan_fold(), fold.mark_fold()))
    return fold.chunk_map(plans.where("planned is not null"), marks)


_STABLE = (
    "WITH "
    + OBSERVATIONS
    + """, c AS (SELECT *, size IS DISTINCT FROM lag(size) OVER (PARTITION BY path ORDER BY scan) AS ch FROM observations),
i AS (SELECT *, max(CASE WHEN ch THEN scan END) OVER (PARTITION BY path ORDER BY scan) AS since FROM c)
SELECT path, scan, scan - since + 1 AS stable_count, scan - since + 1 >= 2 AS ready FROM i"""
)


@BOOK.add(_STABLE)
def str_4_stable_files(spark, sf):
    ready = watch.stable_files(views.observations(spark, sf).drop("event_type"), None)
    return ready.select("path", "scan", "stable_count", "ready")


OBSERVATIONS_RESULTS = (
    "WITH RECURSIVE "
    + OBSERVATIONS
    + """, o AS (SELECT path, scan, size, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS won FROM observations),
w AS (
  SELECT path, scan, size, 1 AS cnt, 0 AS tb, FALSE AS ready, CASE WHEN won = 1 THEN size END AS ds, CASE WHEN won = 0 THEN 1 ELSE 0 END AS ta FROM o WHERE scan = 1
  UNION ALL
  SELECT path, scan, size, cnt, tb, cnt >= 2 AND ds IS DISTINCT FROM size AND tb < 3,
    CASE WHEN won = 1 OR (won = 0 AND tb + 1 >= 3) THEN size ELSE ds END, CASE WHEN won = 1 THEN 0 WHEN won = 0 THEN tb + 1 ELSE tb END
  FROM (SELECT o.path, o.scan, o.size, o.won, w.ds, CASE WHEN o.size = w.size THEN w.cnt + 1 ELSE 1 END AS cnt, CASE WHEN o.size = w.size THEN w.ta ELSE 0 END AS tb
    FROM w JOIN o ON o.path = w.path AND o.scan = w.scan + 1))
SELECT path, scan, cnt::BIGINT AS stable_count, tb::BIGINT AS failures_before, ready FROM w"""
)


def _with_results(spark, sf):
    seen = views.observations(spark, sf)
    status = (
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    )
    return seen.select("path", "scan", "size", "mtime", status.alias("status"))


@BOOK.add(
    OBSERVATIONS_RESULTS
)
def str_4_stable_files_results(spark, sf):
    """With results of earlier scans: retries, giving up, changed files start over."""
    seen = _with_results(spark, sf)
    return watch.stable_files(
        seen.drop("status"), seen.where(F.col("status").isNotNull()).select("path", "scan", "status")
    )


@BOOK.add(
    OBSERVATIONS_RESULTS.replace("SELECT path, scan, cnt::BIGINT", "SELECT 'in/' || path || '.wav' AS path, scan, cnt::BIGINT")
)
def str_4_stable_files_stream(spark, sf):
    """Paths are names here, and results of earlier scans come along."""
    name = F.concat(F.lit("in/"), F.col("path"), F.lit(".wav"))
    seen = _with_results(spark, sf).withColumn("path", name)
    stream = views.stream_of(stage(seen.repartition(4, "path")), 4)
    out = jobs.run_to_table(watch.stable_files_stream(stream))
    return out.select("path", "scan", "stable_count", "failures_before", "ready")


def _to_the_end(spark, events, make, key="run_id"):
    """Rows of a stream over all files of ``events``, run until the watermark has passed them all.

    The files come in any order, so the watermark stays behind the first event until all were read:
    its delay is the time between the first and the last one, and a day. A last file holds one row
    with a key of its own that moves it past the others; its type is the end of a run, which no
    filter for activity leaves out before it has moved the watermark.
    """
    folder = f"{work_folder(spark)}/closed-{uuid.uuid4().hex}"
    events.write.parquet(f"{folder}/log")
    log = spark.read.schema(events.schema).parquet(f"{folder}/log")
    span = log.agg(F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).first()[0] or 0
    delay = f"{span + 86_400} seconds"
    clock = log.agg(F.max_by(F.struct("*"), "ts").alias("last")).where("last IS NOT NULL").select("last.*")
    clock = clock.withColumns({"ts": F.col("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 30 DAYS"), key: F.lit("~clock")})
    if "type" in events.columns:
        clock = clock.withColumn("type", F.lit("run.finished"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/log")
    out = make(source.withWatermark("ts", delay))
    for last in (False, True):
        if last:
            clock.write.mode("append").parquet(f"{folder}/log")
        jobs.start(out, jobs.to_table(f"{folder}/out"), checkpoint=f"{folder}/progress").awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")


@BOOK.add(
    OBSERVATIONS_RESULTS.replace("SELECT path, scan, cnt::BIGINT", "SELECT 'in/' || path || '.wav' AS path, scan, cnt::BIGINT")
)
def str_4_shuffled_scans(spark, sf):
    """Scans in any order give the rows of the table form."""
    name = F.concat(F.lit("in/"), F.col("path"), F.lit(".wav"))
    seen = _with_results(spark, sf).withColumns({"path": name, "ts": F.timestamp_seconds(F.col("scan") * 60)})
    shuffled = seen.repartition(7, F.xxhash64("path", "scan"))
    out = _to_the_end(spark, shuffled, watch.stable_files_in_order, "path").where(F.col("path") != "~clock")
    return out.select("path", "scan", "stable_count", "failures_before", "ready")


SAMPLES_SQL = (
    RUN_EVENTS
    + """,
smp AS (SELECT run_id, ts, seq, CASE WHEN k % 3 = 0 THEN 'nvidia-smi' ELSE 'proc' END AS sampler,
    CASE WHEN k % 3 <> 0 THEN k::DOUBLE END AS cpu_percent, CASE WHEN k % 3 = 0 THEN (k * 2)::DOUBLE END AS gpu_util_percent, k FROM run_events)"""
)


def _samples(spark, sf):
    k = F.col("k")
    gpu = k % 3 == 0
    base = views.run_events(spark, sf)
    known = {"cpu_percent": F.when(~gpu, k.cast("double")), "gpu_util_percent": F.when(gpu, (k * 2).cast("double"))}
    return base.select(
        "run_id",
        "seq",
        "ts",
        F.when(gpu, "nvidia-smi").otherwise("proc").alias("sampler"),
        F.when(k % 10 == 9, F.col("ts") - F.expr("interval 30 seconds")).otherwise(F.col("ts")).alias("read_ts"),
        *[known.get(m, F.lit(None).cast("double")).alias(m) for m in RESOURCE_KEYS],
        "k",
    )


_ROLLUP = (
    "WITH "
    + SAMPLES_SQL
    + """ SELECT run_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start,
  arg_max(cpu_percent, ts) FILTER (WHERE cpu_percent IS NOT NULL) AS cpu_last, round(avg(cpu_percent), 6) AS cpu_avg, max(gpu_util_percent) AS gpu_max,
  max(sampler) FILTER (WHERE sampler = 'nvidia-smi') AS gpu_source, max(sampler) FILTER (WHERE sampler = 'proc') AS host_source
FROM smp WHERE k % 10 <> 9 GROUP BY ALL"""
)


def _rollup(df):
    return df.select(
        "run_id",
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        F.col("cpu_percent_last").alias("cpu_last"),
        F.round("cpu_percent_avg", 6).alias("cpu_avg"),
        F.col("gpu_util_percent_max").alias("gpu_max"),
        "gpu_source",
        "host_source",
    )


@BOOK.add(_ROLLUP)
def str_5_resource_rollup(spark, sf):
    return _rollup(series.resource_rollup(_samples(spark, sf), "1 hour"))


@BOOK.add(_ROLLUP)
def str_5_resource_rollup_stream(spark, sf):
    stream = views.stream_of(stage(_samples(spark, sf))).withWatermark("ts", "60 days")
    out = jobs.run_to_table(series.resource_rollup(stream, "1 hour"), mode="update")
    return _rollup(jobs.latest_update(out, ["run_id", "window_start"]))


_GAP = 600


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + f""", a AS (SELECT run_id, seq, type, ts, lag(ts) OVER w AS p, lag(type) OVER w AS pt FROM run_events WHERE type <> 'resource.sample' WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, seq, round((epoch_us(ts) - epoch_us(p)) / 1e6, 6) AS idle_seconds FROM a WHERE epoch_us(ts) - epoch_us(p) >= {_GAP}000000 AND pt <> 'run.finished'"""
)
def str_6_stalls(spark, sf):
    found = series.stalls(views.run_event_files(spark, sf), _GAP)
    return found.select("run_id", "seq", F.round("idle_seconds", 6).alias("idle_seconds"))


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + f""", a AS (SELECT run_id, seq, type, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS n, lead(seq) OVER w AS nseq FROM run_events WHERE type <> 'resource.sample' WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
q AS (SELECT * FROM a WHERE type <> 'run.finished' AND (n IS NULL OR n - t >= {_GAP}000000))
SELECT run_id, 'raised' AS kind, CAST(NULL AS BIGINT) AS seq, t AS idle_from, t + {_GAP}000000 AS at FROM q
UNION ALL SELECT run_id, 'cleared', nseq, t, n FROM q WHERE n IS NOT NULL"""
)
def str_6_stalls_stream(spark, sf):
    """Alarms of a replayed log: the same as from the whole table, whatever the order of its files."""
    found = _to_the_end(spark, views.run_event_files(spark, sf), lambda s: alarms.stall_alarms(s, _GAP, live=False))
    found = found.where(F.col("run_id") != "~clock")
    return found.select("run_id", "kind", "seq", F.unix_micros("idle_from").alias("idle_from"), F.unix_micros("at").alias("at"))


_SESSIONS = (
    "WITH "
    + RUN_EVENTS
    + f""", a AS (SELECT run_id, ts, seq, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY seq)) >= {_GAP}000000, TRUE) AS opens FROM run_events WHERE type <> 'resource.sample'),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS n FROM a)
SELECT run_id, epoch_us(min(ts)) AS first_event, epoch_us(max(ts)) AS last_event, count(*) AS events FROM s GROUP BY run_id, n"""
)


def _micros(df):
    return df.select(
        "run_id", F.unix_micros("first_event").alias("first_event"), F.unix_micros("last_event").alias("last_event"), "events"
    )


@BOOK.add(_SESSIONS)
def str_6_activity_sessions(spark, sf):
    return _micros(series.activity_sessions(views.run_event_files(spark, sf), _GAP))


@BOOK.add("WITH " + RUN_EVENTS + ", f AS (SELECT min(run_id) AS r FROM run_events WHERE type = 'run.finished') SELECT e.run_id, seq, type FROM run_events e JOIN f ON f.r = e.run_id")
def str_7_follow(spark, sf):
    log = views.run_event_files(spark, sf)
    first = log.where(F.col("type") == "run.finished").agg(F.min("run_id")).first()[0]
    path = f"{work_folder(spark)}/follow-{uuid.uuid4().hex}"
    everything = views.stream_of(log, 1000)
    return jobs.follow(everything, first, path).select("run_id", "seq", "type")


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + """, u AS (SELECT run_id, seq, epoch_us(ts) // 500000 AS tick, type LIKE 'run.%' OR type LIKE 'job.%' OR type LIKE 'stage.%' AS urgent FROM run_events)
SELECT run_id, seq FROM u WHERE urgent UNION ALL SELECT run_id, min(seq) FROM u WHERE NOT urgent GROUP BY run_id, tick"""
)
def str_8_snapshots_due(spark, sf):
    return jobs.snapshots_due(views.run_event_files(spark, sf))


_HEADERS_SQL = (
    "WITH "
    + RUN_EVENTS
    + ", "
    + STATE
    + """, t AS (SELECT run_id, epoch_us(max(ts)) AS shown_at FROM run_events GROUP BY run_id)
SELECT run_id, last_seq, elapsed_s, 'model-' || rk AS model, job_seq, cj::VARCHAR AS current_job, js AS jobs_started, jf AS jobs_finished,
  jfs AS job_finished_seq, CASE WHEN jk % 3 = 0 THEN 'failed' WHEN jk IS NOT NULL THEN 'completed' END AS finished_status, warnings, fin AS finished,
  (fk % 2)::VARCHAR AS exit_status, shown_at FROM h JOIN t USING (run_id)"""
)


@BOOK.add(_HEADERS_SQL)
def str_8_write_status(spark, sf):
    """The status as last shown, of a log that comes in one batch: all columns, and the time of the event it shows."""
    stream = views.stream_of(views.run_event_files(spark, sf), 1000)
    shown = _folded(spark, stream, fold.header_fold(), keep_seconds=10**9, forget_seconds=10**9).status(spark)
    return shown.drop("command", "progress", "progress_seq", "resources").withColumn("shown_at", F.unix_micros("shown_at"))


@BOOK.add(
    "WITH RECURSIVE "
    + RUN_EVENTS
    + """, e AS (SELECT run_id, seq, epoch_us(ts) AS t, type LIKE 'run.%' OR type LIKE 'job.%' OR type LIKE 'stage.%' AS urgent FROM run_events),
w AS (
  SELECT run_id, seq, TRUE AS due, t AS written FROM e WHERE seq = 1
  UNION ALL
  SELECT e.run_id, e.seq, e.urgent OR e.t - w.written >= 900000000, CASE WHEN e.urgent OR e.t - w.written >= 900000000 THEN e.t ELSE w.written END
  FROM w JOIN e ON e.run_id = w.run_id AND e.seq = w.seq + 1)
SELECT run_id, seq, written AS at FROM w WHERE due"""
)
def str_8_write_times(spark, sf):
    """The events that a status is written for, with a quarter of an hour as the interval of this slow log."""
    found = _to_the_end(spark, views.run_event_files(spark, sf), lambda s: alarms.status_writes(s, 900))
    return found.where(F.col("run_id") != "~clock").select("run_id", "seq", F.unix_micros("at").alias("at"))


@BOOK.add("WITH " + RUN_EVENTS + " SELECT job_id, run_id, seq, type FROM run_events WHERE type <> 'resource.sample'")
def snk_1_job_events(spark, sf):
    path = f"{work_folder(spark)}/jobs-{uuid.uuid4().hex}"
    jobs.write_job_events(views.stream_of(views.run_event_files(spark, sf), 1000), path).awaitTermination()
    return jobs.job_log(spark, path).select(F.col("job_id").cast("long").alias("job_id"), "run_id", "seq", "type")


@BOOK.add(
    "WITH "
    + EVENTS
    + """, t AS (SELECT user_id, frame_idx, sum(k) OVER w AS total, sum(k % 7) OVER w AS idle FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, total - lag(total) OVER w AS dt, idle - lag(idle) OVER w AS di FROM t WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx))
SELECT user_id, frame_idx, round(CASE WHEN dt > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * (1 - di::DOUBLE / dt))) END, 6) AS cpu_percent FROM d"""
)
def win_13_counter_rate(spark, sf):
    from ..operators.ordered import running

    block = F.floor(F.col("frame_idx") / 65536)
    counters = running(
        views.attempts_events(spark, sf), ["user_id"], ["frame_idx"], block,
        {"total": ("sum", F.col("k")), "idle": ("sum", F.col("k") % 7)},
    )
    rated = series.counter_rate(stage(counters), ["user_id"], "frame_idx", block)
    return rated.select("user_id", "frame_idx", F.round("cpu_percent", 6).alias("cpu_percent"))


@BOOK.add(
    "WITH "
    + SAMPLES_SQL
    + """, l AS (SELECT run_id, seq, 'cpu_percent' AS metric, cpu_percent AS value FROM smp WHERE cpu_percent IS NOT NULL UNION ALL SELECT run_id, seq, 'gpu_util_percent', gpu_util_percent FROM smp WHERE gpu_util_percent IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric ORDER BY seq DESC) AS n FROM l) SELECT run_id, seq, metric, value FROM r WHERE n <= 60"""
)
def win_14_history(spark, sf):
    return series.history(_samples(spark, sf), ["run_id"], "seq", RESOURCE_KEYS)


@BOOK.add(
    "WITH "
    + EVENTS
    + """, r AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id // 2 AS seq, ts FROM ev),
d AS (SELECT run_id, seq, coalesce(lag(seq) OVER (PARTITION BY run_id ORDER BY seq, ts), 0) AS p FROM r)
SELECT run_id, seq, CASE WHEN seq = p THEN 'repeated' ELSE 'missing before' END AS problem, seq - p - 1 AS missing FROM d WHERE seq = p OR seq > p + 1"""
)
def win_15_sequence_gaps(spark, sf):
    events = views.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.floor(F.col("event_id") / 2).alias("seq"), "ts"
    )
    return series.sequence_gaps(events)


@BOOK.add(
    "WITH "
    + EVENTS
    + """, a AS (SELECT user_id AS job_id, frame_idx // 6 AS chunk_idx, frame_idx % 6 AS attempt_no, k % 2 AS t FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, chunk_idx, t ORDER BY attempt_no) AS n FROM a)
SELECT job_id, chunk_idx, attempt_no, format('{:05d}_t{:03d}', chunk_idx, t * 20) || CASE WHEN n > 1 THEN '_r' || n ELSE '' END || '.json' AS file_name FROM r"""
)
def win_16_audit_names(spark, sf):
    i = F.col("frame_idx")
    attempts = views.attempts_events(spark, sf).select(
        F.col("user_id").alias("job_id"),
        F.floor(i / 6).alias("chunk_idx"),
        (i % 6).alias("attempt_no"),
        F.lit("").alias("part"),
        ((F.col("k") % 2) * 0.2).alias("temperature"),
    )
    return series.audit_names(attempts).drop("part")


@BOOK.add(
    """WITH p AS (SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, value FROM events)
SELECT event_id, (k % 4)::BIGINT AS gpu_index, k::DOUBLE AS gpu_util_percent, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS gpu_mem_used_mb,
  8192.0::DOUBLE AS gpu_mem_total_mb, CASE WHEN k % 6 = 3 THEN NULL ELSE 12.5::DOUBLE END AS gpu_temp_c, CASE WHEN k % 2 = 0 THEN 7.0::DOUBLE END AS gpu_encoder_percent
FROM p WHERE k % 11 <> 0 AND k % 13 <> 0"""
)
def col_9_gpu_lines(spark, sf):
    k, v = F.col("k"), F.col("value").cast("string")
    line = F.when(k % 11 == 0, "0, 50, 3").otherwise(
        F.concat_ws(
            ", ",
            F.when(k % 13 == 0, "[N/A]").otherwise((k % 4).cast("string")),
            k.cast("string"),
            F.when(k % 5 == 0, "[N/A]").otherwise(v),
            F.lit("8192"),
            F.lit("60"),
            F.when(k % 6 == 3, "n/a").otherwise("12.5"),
            F.when(k % 2 == 0, "7"),
        )
    )
    parsed = series.parse_gpu_lines(views.attempts_events(spark, sf).select("event_id", line.alias("line")))
    return parsed.drop("line", "gpu_power_w")


@BOOK.add(
    """WITH p AS (SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events)
SELECT event_id, (k + 5)::BIGINT AS idle, (10 + 2 + 3 + k + 5 + 1 + 1 + 1)::BIGINT AS total FROM p WHERE k % 9 <> 0"""
)
def col_9_cpu_counters(spark, sf):
    k = F.col("k")
    text = F.when(k % 9 == 0, "intr 5\nctxt 3").otherwise(
        F.concat(F.lit("cpu  10 2 3 "), k.cast("string"), F.lit(" 5 1 1 1 9 9\ncpu0 1 1 1 1\n"))
    )
    lines = views.attempts_events(spark, sf).select("event_id", text.alias("text"))
    return series.parse_cpu_counters(lines).select("event_id", "idle", "total")


@BOOK.add(
    """WITH p AS (SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN (204800 - k * 100) / 1024.0::DOUBLE ELSE (204800 - k - 1024) / 1024.0::DOUBLE END AS ram_used_mb,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 200.0::DOUBLE END AS ram_total_mb, k / 1024.0::DOUBLE AS process_rss_mb FROM p"""
)
def col_9_memory(spark, sf):
    k = F.col("k").cast("string")
    n = F.col("k") % 4
    text = F.concat(
        F.when(n != 0, "MemTotal:   204800 kB\n").otherwise(""),
        F.when(n == 1, F.concat(F.lit("MemAvailable: "), (F.col("k") * 100).cast("string"), F.lit(" kB\n"))).otherwise(
            F.concat(F.lit("MemFree: "), k, F.lit(" kB\nCached: 1024 kB\n"))
        ),
        F.lit("VmRSS:\t"),
        k,
        F.lit(" kB\n"),
    )
    lines = views.attempts_events(spark, sf).select("event_id", text.alias("text"))
    return series.parse_memory(lines).drop("text")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
