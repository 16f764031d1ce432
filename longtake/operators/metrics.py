"""Numbers about finished work: execution, confidence, stages, progress. Never any text.

Means and ratios are returned as computed; reports round them half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import degenerate_reason, finite
from .ordered import neighbours, numbered, running
from .percentiles import exact_percentiles

LOW_CONFIDENCE = 0.5
CHUNK_BLOCK = 1 << 16


def is_call(action: str = "action") -> Column:
    """Attempt entries without an action are model calls; the others record a split."""
    return F.col(action).isNull()


def chunk_totals(attempts: DataFrame) -> DataFrame:
    """First level of the summary: one row per chunk that has any attempt."""
    call = is_call()
    tokens = finite(F.col("metrics.completion_tokens"))
    return attempts.groupBy("job_id", "chunk_idx").agg(
        F.sum(F.when(call, F.coalesce("wall_seconds", F.lit(0.0))).otherwise(0.0)).alias("wall"),
        F.sum(F.when(call, F.coalesce("audio_seconds", F.lit(0.0))).otherwise(0.0)).alias("audio"),
        F.count_if(call).alias("calls"),
        F.count(F.when(call, tokens)).alias("token_calls"),
        F.sum(F.when(call, tokens)).alias("tokens"),
        F.max(F.when(call, tokens)).alias("max_tokens"),
        F.count_if(call & F.col("stage").eqNullSafe("temperature")).alias("fallbacks"),
        F.count_if((F.col("action") == "split") & (F.col("outcome") == "ok")).alias("splits"),
        F.collect_list(F.when(call, tokens)).alias("token_values"),  # as many as a chunk has calls
    )


def execution_summary(
    plan: DataFrame, done: DataFrame, failed: DataFrame, attempts: DataFrame, stages: DataFrame
) -> DataFrame:
    """One row per planned job. ``stages(job_id, inference_seconds, analysed_seconds)``.

    Missing wall and audio seconds count as zero; missing token counts are left out. Attempts are
    shuffled once, by chunk; both percentiles and all sums go on from there.
    """
    per_chunk = chunk_totals(attempts)
    totals = per_chunk.groupBy("job_id").agg(
        F.sum("wall").alias("wall"),
        F.sum("audio").alias("audio"),
        F.sum("calls").alias("attempts"),
        F.sum("token_calls").alias("token_calls"),
        F.sum("tokens").alias("tokens_sum"),
        F.max("max_tokens").alias("tokens_max"),
        F.avg("wall").alias("chunk_mean"),
        F.max("wall").alias("chunk_max"),
        F.sum("fallbacks").alias("fallbacks"),
        F.sum("splits").alias("splits"),
    )
    # Both percentiles in one pass, told apart by a measure name in the key.
    measured = per_chunk.select(
        "job_id", F.lit("chunk").alias("measure"), F.round("wall", 3).alias("value")
    ).unionByName(
        per_chunk.select("job_id", F.lit("tokens").alias("measure"), F.explode("token_values").alias("value"))
    )
    p95 = exact_percentiles(
        measured, ["job_id", "measure"], F.col("value"), {"p95": (0.95, "nearest")}
    )
    p95 = p95.groupBy("job_id").agg(
        F.max(F.when(F.col("measure") == "chunk", F.col("p95"))).alias("chunk_p95"),
        F.max(F.when(F.col("measure") == "tokens", F.col("p95"))).alias("tokens_p95"),
    )
    # Counts of the three chunk tables in one aggregate instead of three joins.
    counts = (
        plan.select("job_id", F.lit("plan").alias("kind"))
        .unionByName(
            done.select("job_id", F.when(F.size("segments") > 0, "ok").otherwise("no_speech").alias("kind"))
        )
        .unionByName(failed.select("job_id", F.lit("failed").alias("kind")))
        .groupBy("job_id")
        .agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (
            ("plan", "total_chunks"), ("ok", "chunks_ok"), ("no_speech", "chunks_no_speech"), ("failed", "chunks_failed"),
        )])
        .where(F.col("total_chunks") > 0)
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    wall = F.coalesce("wall", F.lit(0.0))
    return (
        counts.join(totals, "job_id", "left")
        .join(p95, "job_id", "left")
        .join(stages, "job_id", "left")
        .select(
            "job_id",
            "total_chunks",
            "chunks_ok",
            "chunks_no_speech",
            "chunks_failed",
            F.coalesce("audio", F.lit(0.0)).alias("audio_seconds_sent"),
            wall.alias("request_seconds_sum"),
            F.when(
                F.col("inference_seconds") > 0, wall / F.col("inference_seconds")
            ).alias("effective_concurrency"),
            F.when(
                F.col("analysed_seconds") > 0, wall / F.col("analysed_seconds")
            ).alias("real_time_factor"),
            zero("token_calls"),
            F.coalesce("tokens_sum", F.lit(0.0)).alias("tokens_sum"),
            "tokens_max",
            "tokens_p95",
            "chunk_mean",
            "chunk_p95",
            "chunk_max",
            zero("attempts"),
            zero("fallbacks"),
            zero("splits"),
        )
    )


def chunk_confidence(done: DataFrame, attempts: DataFrame) -> DataFrame:
    """Mean token probability per completed chunk, weighted by tokens over its ok attempts."""
    mean = finite(F.col("metrics.mean_token_prob"))
    tokens = F.col("metrics.logprob_tokens")
    weight = F.when(tokens > 0, tokens).otherwise(1).cast("double")
    ok = attempts.where((F.col("outcome") == "ok") & mean.isNotNull())
    return (
        ok.groupBy("job_id", "chunk_idx")
        .agg(F.sum(mean * weight).alias("total"), F.sum(weight).alias("weight"))
        .join(done.select("job_id", "chunk_idx"), ["job_id", "chunk_idx"], "left_semi")
        .select("job_id", "chunk_idx", (F.col("total") / F.col("weight")).alias("mean"), "weight")
    )


def confidence_summary(per_chunk: DataFrame) -> DataFrame:
    """Per job: token-weighted mean, nearest-rank 10th percentile chunk, low chunks."""
    p10 = exact_percentiles(per_chunk, ["job_id"], F.col("mean"), {"p10": (0.1, "nearest")})
    return (
        per_chunk.groupBy("job_id")
        .agg(
            F.sum(F.col("mean") * F.col("weight")).alias("s"),
            F.sum("weight").alias("w"),
            F.count_if(F.col("mean") < LOW_CONFIDENCE).alias("low_chunks"),
        )
        .join(p10, "job_id")
        .select(
            "job_id",
            (F.col("s") / F.col("w")).alias("mean"),
            F.col("p10").alias("p10_chunk"),
            "low_chunks",
        )
    )


def stage_totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds per stage over all runs; a stage no run could measure stays null."""
    return (
        runs.select(*keys, F.explode("stages_seconds").alias("stage", "seconds"))
        .groupBy(*keys, "stage")
        .agg(F.sum(finite(F.col("seconds"))).alias("seconds"))
    )


def token_profile(responses: DataFrame, logprobs: str) -> DataFrame:
    """Mean, smallest and number of token probabilities per response; null when there are none.

    ``logprobs`` is an array column, read in place: one response never leaves its row.
    """
    probs = F.transform(
        F.filter(logprobs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        lambda x: F.exp(F.least(F.lit(0.0), x.cast("double"))),
    )
    n = F.size("__p")
    total = F.aggregate("__p", F.lit(0.0), lambda a, x: a + x)
    return responses.withColumn("__p", probs).select(
        *responses.columns,
        F.when(n > 0, total / n).alias("mean_token_prob"),
        F.when(n > 0, F.array_min("__p")).alias("min_token_prob"),
        F.when(n > 0, n.cast("long")).alias("logprob_tokens"),
    )


def ladder_resolution(attempts: DataFrame) -> DataFrame:
    """Per chunk: final outcome, winning stage, number of calls, reason of the last failure."""
    calls = attempts.where(is_call())
    won = F.col("outcome").isin("ok", "no_speech")
    last = F.max_by(
        F.struct("outcome", degenerate_reason(F.col("metrics.finish_reason"), F.col("error")).alias("reason")),
        "attempt_no",
    )
    return (
        calls.groupBy("job_id", "chunk_idx")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.max_by(F.when(won, F.col("stage")), F.when(won, F.col("attempt_no"))).alias("winning_stage"),
            last.alias("last"),
        )
        .select(
            "job_id",
            "chunk_idx",
            "calls",
            F.when(F.col("last.outcome").isin("ok", "no_speech"), F.col("last.outcome"))
            .otherwise("failed")
            .alias("outcome"),
            F.when(F.col("last.outcome").isin("ok", "no_speech"), F.col("winning_stage")).alias("winning_stage"),
            F.when(~F.col("last.outcome").isin("ok", "no_speech"), F.col("last.reason")).alias("reason"),
        )
    )


def gap_report(failed: DataFrame, attempts: DataFrame) -> DataFrame:
    """Failed chunks in order with their span and last recorded error: one row per gap."""
    message = F.when(
        F.length("error") > 0, F.concat(F.coalesce("outcome", F.lit("error")), F.lit(": "), F.col("error"))
    )
    errors = attempts.groupBy("job_id", "chunk_idx").agg(
        F.max_by(message, F.when(message.isNotNull(), F.col("attempt_no"))).alias("last_error"),
        F.count(F.lit(1)).alias("entries"),
    )
    joined = failed.select("job_id", "chunk_idx", "start", "end").join(
        errors, ["job_id", "chunk_idx"], "left"
    )
    return numbered(
        joined, ["job_id"], ["chunk_idx"], F.floor(F.col("chunk_idx") / CHUNK_BLOCK), "gap_no"
    ).select(
        "job_id",
        "gap_no",
        "chunk_idx",
        "start",
        "end",
        F.coalesce("entries", F.lit(0).cast("long")).alias("entries"),
        F.coalesce("last_error", F.lit("no usable transcription")).alias("error"),
    )


def notable_histories(attempts: DataFrame) -> DataFrame:
    """Chunks whose history is worth reading: more than one entry, or any that is not ok."""
    return (
        attempts.groupBy("job_id", "chunk_idx")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(~F.col("outcome").eqNullSafe("ok")).alias("not_ok"),
        )
        .where((F.col("entries") > 1) | (F.col("not_ok") > 0))
    )


def progress_series(finished: DataFrame, plan_totals: DataFrame, seeds: DataFrame) -> DataFrame:
    """Progress after every finished chunk.

    ``finished(job_id, seq, elapsed_s, outcome, audio_seconds, tokens, conf_sum, conf_weight)``;
    ``plan_totals(job_id, total_chunks, audio_total)``; ``seeds(job_id, seed_ok, seed_no_speech,
    seed_audio)`` for chunks done by earlier runs, which count as done but not as throughput.
    """
    n = lambda kind: F.when(F.col("outcome") == kind, 1).otherwise(0).cast("long")
    counted = running(
        finished,
        ["job_id"],
        ["seq"],
        F.floor(F.col("seq") / CHUNK_BLOCK),
        {
            "ok": ("sum", n("ok")),
            "no_speech": ("sum", n("no_speech")),
            "failed": ("sum", n("failed")),
            "run_audio": ("sum", F.col("audio_seconds")),
            "tokens_done": ("sum", F.col("tokens")),
            "cs": ("sum", F.col("conf_sum")),
            "cw": ("sum", F.col("conf_weight")),
        },
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok, silent = F.col("ok") + zero("seed_ok"), F.col("no_speech") + zero("seed_no_speech")
    done = ok + silent + F.col("failed")
    audio_done = F.col("run_audio") + zero("seed_audio")
    throughput = F.when(
        (F.col("elapsed_s") > 0) & (F.col("run_audio") > 0), F.col("run_audio") / F.col("elapsed_s")
    )
    left = F.greatest(F.lit(0.0), F.col("audio_total") - audio_done)
    total = F.col("total_chunks")
    return (
        counted.join(plan_totals, "job_id")
        .join(seeds, "job_id", "left")
        .select(
            "job_id",
            "seq",
            ok.alias("ok"),
            silent.alias("no_speech"),
            "failed",
            done.alias("done_chunks"),
            "total_chunks",
            F.when(total > 0, 100.0 * done / total).otherwise(100.0).alias("percent"),
            audio_done.alias("audio_done_s"),
            "elapsed_s",
            F.when(throughput.isNotNull(), F.when(left <= 0, 0.0).otherwise(left / throughput)).alias("eta_s"),
            (1.0 / throughput).alias("real_time_factor"),
            throughput.alias("throughput_x"),
            F.col("tokens_done").alias("tokens"),
            F.when(F.col("cw") > 0, F.col("cs") / F.col("cw")).alias("confidence_mean"),
        )
    )


def in_flight(events: DataFrame) -> DataFrame:
    """Chunks being worked on after each start or finish event, and the highest count so far.

    A second start of a running chunk, or a finish of one not running, changes nothing.
    ``events(job_id, seq, chunk_idx, kind)`` with kind ``started`` or ``finished``.
    """
    block = F.floor(F.col("seq") / CHUNK_BLOCK)
    known = neighbours(
        events, ["job_id", "chunk_idx"], ["seq"], block, before={"prev_kind": F.col("kind")}
    )
    was = F.col("prev_kind").eqNullSafe("started")
    delta = (
        F.when((F.col("kind") == "started") & ~was, 1)
        .when((F.col("kind") == "finished") & was, -1)
        .otherwise(0)
        .cast("long")
    )
    gauge = running(
        known.withColumn("delta", delta), ["job_id"], ["seq"], block, {"in_flight": ("sum", F.col("delta"))}
    )
    return gauge.select("job_id", "seq", "chunk_idx", "kind", "in_flight")


def peak_in_flight(gauge: DataFrame) -> DataFrame:
    return gauge.groupBy("job_id").agg(F.max("in_flight").alias("max_in_flight"))


def job_rollup(summary: DataFrame, confidence: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What a finished (or reused) job reports: counts, tokens, confidence, wall, artifacts.

    ``runs(job_id, wall_seconds, ended)``; ``artifacts(job_id, name)``. The artifact list is
    bounded by the fixed set of file names.
    """
    walls = runs.groupBy("job_id").agg(
        F.sum(F.coalesce("wall_seconds", F.lit(0.0))).alias("wall_seconds"),
        F.max("ended").alias("ended"),
        F.count(F.lit(1)).alias("runs"),
    )
    files = (
        artifacts.select("job_id", "name")
        .distinct()
        .groupBy("job_id")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("artifacts"))
    )
    return (
        summary.select(
            "job_id", "total_chunks", "chunks_ok", "chunks_no_speech", "chunks_failed", "tokens_sum"
        )
        .join(confidence.select("job_id", F.col("mean").alias("confidence")), "job_id", "left")
        .join(walls, "job_id", "left")
        .join(files, "job_id", "left")
    )


def summary_lines(rollup: DataFrame) -> DataFrame:
    """One plain line per job: status, name, counts, confidence, wall, error."""
    part = lambda label, c, tail="": F.when(
        F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c).cast("string"), F.lit(tail))
    )
    counts = F.when(
        F.col("total_chunks").isNotNull(),
        F.format_string(
            "chunks ok=%d no_speech=%d failed=%d of %d",
            "chunks_ok", "chunks_no_speech", "chunks_failed", "total_chunks",
        ),
    )
    return rollup.select(
        "job_id",
        F.concat_ws(
            " | ",
            F.col("status"),
            F.col("job_id").cast("string"),
            counts,
            part("confidence ", "confidence"),
            part("wall ", "wall_seconds", "s"),
            part("error: ", "error"),
        ).alias("line"),
    )
