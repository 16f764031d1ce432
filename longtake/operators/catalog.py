"""The catalog: versions per source, the latest one, where a source is, what a queue will take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import duration_text
from .ordered import first_per_key, numbered

DEFAULT_RTF = 0.04
PREVIEW_CHARS = 220
# Which report speaks for a version, best first.
REPORT_KINDS = ["final", "private", "intermediate"]


def completion(df: DataFrame) -> DataFrame:
    """Add ``completion_percent``: report counts before checkpoint counts; null when unknown.

    Needs ``status, report_total, report_done, chunk_count, checkpoint_done``.
    """
    reported = F.col("report_total").isNotNull() & F.col("report_done").isNotNull()
    total = F.when(reported, F.col("report_total")).otherwise(F.col("chunk_count"))
    done = F.when(reported, F.col("report_done")).otherwise(
        F.coalesce("checkpoint_done", F.when(F.col("status") == "prepared", 0))
    )
    percent = F.when(total > 0, 100.0 * F.least(done, total) / total)
    return df.withColumn(
        "completion_percent",
        F.when(F.col("status") == "completed", 100.0).when(done.isNotNull(), percent),
    )


def version_summary(meta: DataFrame, reports: DataFrame) -> DataFrame:
    """Every version known from metadata or from a report, each attribute from the best place.

    ``meta(source, version, status, model, config_model, language, chunk_count, created)``,
    ``reports(source, version, kind, model, total_chunks, completed_chunks)``.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in REPORT_KINDS]), F.col("kind"))
    best = (
        reports.where(F.col("kind").isin(REPORT_KINDS))
        .groupBy("source", "version")
        .agg(F.min_by(F.struct("kind", "model", "total_chunks", "completed_chunks"), rank).alias("report"))
    )
    both = meta.join(best, ["source", "version"], "full_outer")
    return both.select(
        "source",
        "version",
        F.coalesce(
            "status",
            F.when(F.col("report.kind").isin("final", "private"), "completed").otherwise("incomplete"),
        ).alias("status"),
        F.coalesce("model", "config_model", "report.model").alias("model"),
        "language",
        "created",
        F.when(F.col("report.kind") == "intermediate", "intermediate")
        .when(F.col("report.kind").isNotNull(), "final")
        .alias("report_kind"),
        F.coalesce("report.total_chunks", "chunk_count").alias("total_chunks"),
        F.col("report.total_chunks").alias("report_total"),
        F.col("report.completed_chunks").alias("report_done"),
        "chunk_count",
    )


def newest_first(versions: DataFrame) -> DataFrame:
    """Position of each version within its source: 0 is the newest, ties broken fully."""
    counts = versions.groupBy("source").agg(F.count(F.lit(1)).alias("__count"))
    placed = numbered(
        versions, ["source"], ["created", "updated", "version"], F.date_trunc("month", "created"), "__pos"
    )
    return (
        placed.join(counts, "source")
        .withColumn("newest_no", F.col("__count") - 1 - F.col("__pos"))
        .drop("__count", "__pos")
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """One row per source: its latest version, activity, and first known size and duration."""
    age = F.struct("created", "updated", "version")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version")))
    return (
        versions.groupBy("source")
        .agg(
            F.max_by(F.struct("version", "status", "model"), age).alias("latest"),
            F.max("updated").alias("last_activity"),
            F.count(F.lit(1)).alias("version_count"),
            known("duration").alias("duration_seconds"),
        )
        .select(
            "source",
            F.col("latest.version").alias("version"),
            F.col("latest.status").alias("status"),
            F.col("latest.model").alias("model"),
            "last_activity",
            "version_count",
            "duration_seconds",
        )
    )


def catalog_order(latest: DataFrame) -> DataFrame:
    """Most recent activity first, then the folder, descending."""
    return latest.orderBy(F.desc("last_activity"), F.desc("source"))


def source_names(versions: DataFrame, name: str) -> DataFrame:
    """Distinct names of each source, newest use first, one row per name."""
    used = versions.groupBy("source", name).agg(F.max("version").alias("last_used"))
    return used.where(F.col(name).isNotNull())


def locate(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where each source can be found: the first candidate that exists and matches its size.

    ``sources(source, size)``, ``candidates(source, preference, kind, path, present,
    candidate_size)``; an unknown size matches anything, nothing found is ``missing``. With
    ``mtime`` on both sides the time has to match too.
    """
    same = F.col("size").isNull() | (F.col("size") == F.col("candidate_size"))
    if "mtime" in sources.columns:
        same &= F.col("mtime") == F.col("candidate_mtime")
    found = (
        candidates.where("present")
        .join(sources, "source")
        .where(same)
        .groupBy("source")
        .agg(F.min_by(F.struct("kind", "path"), F.struct("preference", "path")).alias("place"))
    )
    return sources.join(found, "source", "left").select(
        "source",
        F.coalesce("place.kind", F.lit("missing")).alias("kind"),
        F.col("place.path").alias("path"),
    )


def measured_rtf(versions: DataFrame, sources: int | None = None) -> DataFrame:
    """One row: the real-time factor of the newest completed version that has one, null for none.

    Sources are searched by their last activity, the most active first: all of them, or the first
    ``sources``. One aggregate per source and one over the sources; nothing is joined.
    """
    usable = (F.col("status") == "completed") & (F.col("rtf") > 0)
    newest = F.when(usable, F.struct("created", "updated", "version"))
    active = versions.groupBy("source").agg(F.max("updated").alias("activity"), F.max_by("rtf", newest).alias("rtf"))
    if sources is not None:
        active = active.orderBy(F.desc("activity"), F.desc("source")).limit(sources)
    measured = F.when(F.col("rtf").isNotNull(), F.struct("activity", "source"))
    return active.agg(F.max_by("rtf", measured).alias("rtf"))


def estimate_queue(queue: DataFrame, versions: DataFrame, sources: int | None = None) -> DataFrame:
    """Expected processing time of every queued recording, as seconds and as text."""
    rtf = F.coalesce(measured_rtf(versions, sources).scalar(), F.lit(DEFAULT_RTF))
    timed = queue.withColumn("estimate_seconds", F.col("duration") * rtf)
    return timed.withColumn(
        "estimate", F.when(F.col("duration").isNotNull(), duration_text(F.col("estimate_seconds")))
    )


def estimate_total(estimates: DataFrame) -> DataFrame:
    return estimates.agg(
        F.count(F.lit(1)).alias("recordings"), F.sum("estimate_seconds").alias("estimate_seconds")
    )


def recent_texts(done: DataFrame, plan: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` transcribed chunks of each job with their planned start and a preview."""
    latest = first_per_key(done, ["job_id"], [F.desc("chunk_idx")], n)
    words = F.trim(F.concat_ws(" ", F.transform("segments", lambda s: F.trim(s["text"]))))
    return latest.join(plan.select("job_id", "chunk_idx", "start"), ["job_id", "chunk_idx"], "left").select(
        "job_id", "chunk_idx", "start", F.substring(words, 1, PREVIEW_CHARS).alias("text")
    )


def rebuild_catalog(versions: DataFrame, path: str) -> DataFrame:
    """Write the derived table anew; running it again gives the same table."""
    latest_versions(versions).write.mode("overwrite").parquet(path)
    return versions.sparkSession.read.parquet(path)
