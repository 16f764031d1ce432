"""Filters and decisions over listings, versions and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INF, finite

MIN_SELECTION = 0.05
SELECTION_SLACK = 0.001


def select_interval(df: DataFrame) -> DataFrame:
    """Validate and clamp ``(start, end, duration)``; an exact full range is the full scope."""
    start, end, duration = F.col("start"), F.col("end"), F.col("duration")
    valid = (
        finite(start).isNotNull()
        & finite(end).isNotNull()
        & (start >= 0)
        & (start < end)
        & (end <= duration + SELECTION_SLACK)
        & (end - start >= MIN_SELECTION)
    )
    clamped = F.least(end, duration)
    full = (start == 0) & (F.abs(clamped - duration) < SELECTION_SLACK)
    ok = F.coalesce(valid, F.lit(False))
    return df.withColumns(
        {
            "valid": ok,
            "selected_end": F.when(ok, clamped),
            "selected_seconds": F.when(ok, clamped - start),
            "scope": F.when(ok, F.when(full, "full").otherwise("bounded")),
        }
    )


def rebase(segments: DataFrame, selections: DataFrame) -> DataFrame:
    """Segments inside a job's selection, cut to it, with times counted from its start.

    ``selections(job_id, selected_start, selected_end)``.
    """
    begin, finish = F.col("selected_start"), F.col("selected_end")
    return (
        segments.join(selections, "job_id")
        .where((F.col("end") > begin) & (F.col("start") < finish))
        .withColumn("start", F.greatest(F.col("start"), begin) - begin)
        .withColumn("end", F.least(F.col("end"), finish) - begin)
        .drop("selected_start", "selected_end")
    )


def gate_sources(df: DataFrame, max_bytes: int | None, limit: int | None = None) -> DataFrame:
    """Sources in queue order with the reason they are rejected, if any.

    The limit takes the first of the ordered list before any size is looked at.
    """
    ordered = queue_order(df, limit)
    reason = F.when(F.col("length").isNull(), "could not be inspected")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "larger than the size limit")
    else:
        reason = F.lit(None).cast("string")
    return ordered.withColumn("rejected", reason)


def queue_order(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Case-folded path order; a limit is a top-k, never a full sort in one place."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    ordered = df.orderBy(F.lower("path"), "path")
    return ordered if limit is None else ordered.limit(limit)


def retention_reason(
    audio: Column, source: Column, sample_rate: Column, bounded: Column
) -> Column:
    """Why an original has to stay, or null when it may be archived; the first reason wins."""
    frame = F.when(sample_rate > 0, 1.0 / sample_rate).otherwise(0.0)
    return (
        F.when(audio.isNull() | source.isNull(), "duration unavailable")
        .when(finite(audio).isNull() | finite(source).isNull(), "duration invalid")
        .when(audio + F.greatest(frame, F.lit(0.05)) < source, "only part was processed")
        .when(bounded, "bounded run")
    )


def batch_status(results: DataFrame) -> DataFrame:
    """Exit status of a batch: 1 when any job failed or stayed incomplete."""
    return results.agg(
        F.when(F.bool_or(F.col("status").isin("failed", "incomplete")), 1).otherwise(0).alias("exit_status"),
        F.count(F.lit(1)).alias("jobs"),
    )


def source_outcome(records: DataFrame, listing: DataFrame) -> DataFrame:
    """What became of each queued recording, from its records and what is still listed.

    ``records(job_id, path, status, archived_path, deleted, policy, warning, scope_kind, backend,
    in_queue_root)``, ``listing(path)``.
    """
    there = listing.select("path").distinct()
    present = there.withColumn("present", F.lit(True))
    archived = there.select(F.col("path").alias("archived_path"), F.lit(True).alias("archive_present"))
    joined = records.join(present, "path", "left").join(archived, "archived_path", "left")
    here = F.coalesce("present", F.lit(False))
    state = (
        F.when(~here & F.coalesce("archive_present", F.lit(False)), "archived")
        .when(~here & F.coalesce("deleted", F.lit(False)), "deleted")
        .when(~here, "gone")
        .otherwise("kept")
    )
    why = (
        F.when(~here, F.lit(None).cast("string"))
        .when(F.length("warning") > 0, F.col("warning"))
        .when(~F.coalesce(F.col("status").isin("completed", "skipped"), F.lit(False)), "the job did not finish")
        .when(F.coalesce(F.col("scope_kind") != "full", F.lit(False)), "only part was transcribed")
        .when(F.col("backend").eqNullSafe("mock"), "mock output keeps the recording")
        .when(~F.col("in_queue_root"), "outside the queue folder")
        .otherwise("archiving was not applied")
    )
    return joined.select("job_id", state.alias("state"), why.alias("reason"))
