"""Live state from events. The same aggregates serve tables and streams.

Every attribute is the value of the event with the largest sequence number that sets it, so the
order in which events arrive does not matter and a replay changes nothing. Aggregates combine
before they are shuffled; one run with most of the events is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import first_per_key
from .tables import Attribute, Fold

MARKS_PER_PART = 1000


def _data(key: str) -> Column:
    return F.get_json_object("data", f"$.{key}")


def _is(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def _latest(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")))


def _last_seq(when: Column) -> Column:
    return F.max(F.when(when, F.col("seq")))


def run_headers(events: DataFrame) -> DataFrame:
    """One row per run: what started it, the current job, counters, how it ended."""
    level = F.coalesce(_data("level"), F.when(_is("warning"), "warning").otherwise("info"))
    return events.groupBy("run_id").agg(
        F.max("seq").alias("last_seq"),
        F.max("elapsed_s").alias("elapsed_s"),
        _latest(_data("command"), _is("run.started")).alias("command"),
        _latest(_data("model"), _is("run.started")).alias("model"),
        _last_seq(_is("job.started")).alias("job_seq"),
        _latest(F.col("job_id"), _is("job.started")).alias("current_job"),
        F.count_if(_is("job.started")).alias("jobs_started"),
        F.count_if(_is("job.finished")).alias("jobs_finished"),
        _last_seq(_is("job.finished")).alias("job_finished_seq"),
        _latest(_data("status"), _is("job.finished")).alias("finished_status"),
        _last_seq(_is("progress")).alias("progress_seq"),
        _latest(F.col("data"), _is("progress")).alias("progress"),
        F.count_if(_is("log", "warning") & (level != "info")).alias("warnings"),
        F.bool_or(_is("run.finished")).alias("finished"),
        _latest(_data("exit_status"), _is("run.finished")).alias("exit_status"),
        _latest(F.col("data"), _is("resource.sample")).alias("resources"),
    )


def run_stages(events: DataFrame) -> DataFrame:
    """One row per run and stage: when it last started and finished, and its seconds."""
    return (
        events.where(_is("stage.started", "stage.finished"))
        .groupBy("run_id", _data("stage").alias("stage"))
        .agg(
            _last_seq(_is("stage.started")).alias("started_seq"),
            _last_seq(_is("stage.finished")).alias("finished_seq"),
            _latest(_data("seconds").cast("double"), _is("stage.finished")).alias("seconds"),
        )
    )


def stage_states(headers: DataFrame, stages: DataFrame) -> DataFrame:
    """State of each stage of the current job; events before that job started do not count."""
    began, ended = F.col("started_seq"), F.col("finished_seq")
    job = F.col("job_seq")
    live = stages.join(headers.select("run_id", "job_seq", "job_finished_seq"), "run_id").where(
        F.greatest(began, ended) > job
    )
    running = (began > job) & (ended.isNull() | (began > ended))
    return live.select(
        "run_id",
        "stage",
        F.when(running, "running").otherwise("done").alias("state"),
        F.when(ended > job, F.col("seconds")).alias("seconds"),
        F.when(began > job, began).alias("started_seq"),
        (running & (F.coalesce("job_finished_seq", F.lit(-1)) < began)).alias("open"),
    )


def run_state(headers: DataFrame, stages: DataFrame) -> DataFrame:
    """The status of each run, put together from the two aggregates."""
    current = (
        stage_states(headers, stages)
        .groupBy("run_id")
        .agg(F.max_by(F.struct("stage", "open"), "started_seq").alias("s"))
        .select("run_id", F.when(F.col("s.open"), F.col("s.stage")).alias("current_stage"))
    )
    job_over = F.col("job_finished_seq") > F.col("job_seq")
    return headers.join(current, "run_id", "left").select(
        "run_id",
        F.when(F.col("finished"), "finished").otherwise("running").alias("state"),
        "last_seq",
        "elapsed_s",
        "command",
        "model",
        "current_job",
        F.when(F.col("job_seq").isNotNull(), F.when(job_over, F.col("finished_status")).otherwise("running")).alias("job_status"),
        "current_stage",
        F.when(F.col("progress_seq") > F.col("job_seq"), F.col("progress")).alias("progress"),
        "jobs_started",
        "jobs_finished",
        "warnings",
        "exit_status",
        "resources",
    )


def finished_jobs(events: DataFrame) -> DataFrame:
    """The jobs list of a run, one row per finished job."""
    return events.where(_is("job.finished")).select(
        "run_id", "seq", "job_id", _data("status").alias("status"), _data("error").alias("error")
    )


def recent_activity(events: DataFrame, n: int = 40) -> DataFrame:
    """The last ``n`` log and warning lines of each run."""
    lines = events.where(_is("log", "warning")).select(
        "run_id",
        "seq",
        F.coalesce(_data("level"), F.when(_is("warning"), "warning").otherwise("info")).alias("level"),
        F.coalesce(_data("message"), F.lit("")).alias("text"),
    )
    return first_per_key(lines, ["run_id"], [F.desc("seq")], n)


# --- chunk map ------------------------------------------------------------------------------


def plans(events: DataFrame) -> DataFrame:
    """Per run: size of the last plan and when it was made."""
    size = _data("planned").cast("long")
    return (
        events.where(_is("job.prepared") & size.isNotNull())
        .groupBy("run_id")
        .agg(F.max("seq").alias("plan_seq"), F.max_by(size, "seq").alias("planned"))
    )


def chunk_marks(events: DataFrame) -> DataFrame:
    """Per run and chunk: the mark set by its latest event."""
    outcome = _data("outcome")
    mark = (
        F.when(_is("chunk.started"), "a")
        .when(outcome == "ok", "o")
        .when(outcome == "no_speech", "s")
        .otherwise("f")
    )
    return (
        events.where(_is("chunk.started", "chunk.finished"))
        .groupBy("run_id", _data("index").cast("long").alias("chunk_idx"))
        .agg(F.max("seq").alias("mark_seq"), F.max_by(mark, "seq").alias("mark"))
    )


def chunk_map(plan: DataFrame, marks: DataFrame) -> DataFrame:
    """One mark per planned chunk as strings of bounded length, in parts; a new plan resets."""
    grid = plan.select(
        "run_id", "plan_seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("planned") - 1)).alias("chunk_idx")
    )
    known = F.when(F.col("mark_seq") > F.col("plan_seq"), F.col("mark"))
    marked = grid.join(marks, ["run_id", "chunk_idx"], "left").withColumn("m", F.coalesce(known, F.lit(".")))
    part = F.floor(F.col("chunk_idx") / MARKS_PER_PART).cast("long")
    listed = F.sort_array(F.collect_list(F.struct("chunk_idx", "m")))
    return marked.groupBy("run_id", part.alias("part_no")).agg(
        F.array_join(F.transform(listed, lambda x: x["m"]), "").alias("marks")
    )


# --- the same as folds of a state table -------------------------------------------------------


def header_fold() -> Fold:
    """What ``run_headers`` gives, kept batch by batch."""
    level = F.coalesce(_data("level"), F.when(_is("warning"), "warning").otherwise("info"))
    always, seq, started = F.lit(True), F.col("seq"), _is("job.started")
    return Fold(
        ("run_id",),
        (
            Attribute("last_seq", "max", always, seq),
            Attribute("elapsed_s", "max", always, F.col("elapsed_s")),
            Attribute("command", "last", _is("run.started"), _data("command")),
            Attribute("model", "last", _is("run.started"), _data("model")),
            Attribute("job_seq", "max", started, seq),
            Attribute("current_job", "last", started, F.col("job_id")),
            Attribute("jobs_started", "count", started),
            Attribute("jobs_finished", "count", _is("job.finished")),
            Attribute("job_finished_seq", "max", _is("job.finished"), seq),
            Attribute("finished_status", "last", _is("job.finished"), _data("status")),
            Attribute("progress_seq", "max", _is("progress"), seq),
            Attribute("progress", "last", _is("progress"), F.col("data")),
            Attribute("warnings", "count", _is("log", "warning") & (level != "info")),
            Attribute("finished", "any", _is("run.finished")),
            Attribute("exit_status", "last", _is("run.finished"), _data("exit_status")),
            Attribute("resources", "last", _is("resource.sample"), F.col("data")),
        ),
    )


def stage_fold() -> Fold:
    """What ``run_stages`` gives."""
    began, ended = _is("stage.started"), _is("stage.finished")
    return Fold(
        ("run_id", "stage"),
        (
            Attribute("started_seq", "max", began, F.col("seq")),
            Attribute("finished_seq", "max", ended, F.col("seq")),
            Attribute("seconds", "last", ended, _data("seconds").cast("double")),
        ),
        lambda events: events.where(began | ended).withColumn("stage", _data("stage")),
    )


def plan_fold() -> Fold:
    """What ``plans`` gives."""
    made = _is("job.prepared") & _data("planned").cast("long").isNotNull()
    return Fold(
        ("run_id",),
        (Attribute("plan_seq", "max", made, F.col("seq")), Attribute("planned", "last", made, _data("planned").cast("long"))),
    )


def mark_fold() -> Fold:
    """What ``chunk_marks`` gives."""
    outcome = _data("outcome")
    mark = F.when(_is("chunk.started"), "a").when(outcome == "ok", "o").when(outcome == "no_speech", "s").otherwise("f")
    return Fold(
        ("run_id", "chunk_idx"),
        (Attribute("mark_seq", "max", F.lit(True), F.col("seq")), Attribute("mark", "last", F.lit(True), mark)),
        lambda events: events.where(_is("chunk.started", "chunk.finished")).withColumn("chunk_idx", _data("index").cast("long")),
    )
