"""Queries for metrics and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import request_budget
from ..operators import metrics
from ..operators.percentiles import exact_percentiles
from ..plans import views
from ..session import stage
from .base import ATTEMPTS, EVENTS, RUN_EVENTS, SEGMENTS, Book, rounded

BOOK = Book()
STEP = views.FRAME_SECONDS * 3

SUMMARY = (
    ATTEMPTS
    + """,
per_chunk AS (SELECT job_id, chunk_idx, sum(wall_cents) AS wall FROM attempts GROUP BY ALL),
chunk_stats AS (
  SELECT job_id, round(sum(wall) / 100.0::DOUBLE / count(*), 9) AS chunk_mean,
         list_sort(list(wall / 100.0::DOUBLE)) [greatest(1, CAST(ceil(0.95::DOUBLE * count(*)) AS BIGINT))] AS chunk_p95,
         max(wall) / 100.0::DOUBLE AS chunk_max FROM per_chunk GROUP BY job_id),
call_stats AS (
  SELECT job_id, sum(wall_cents) / 100.0::DOUBLE AS wall, count(*) AS calls, sum(k) AS tokens, max(k) AS tmax,
         list_sort(list(k)) [greatest(1, CAST(ceil(0.95::DOUBLE * count(*)) AS BIGINT))] AS tp95,
         count(*) FILTER (WHERE stage = 'temperature') AS fallbacks FROM attempts GROUP BY job_id),
chunk_counts AS (
  SELECT job_id, count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'no_speech') AS ns,
         count(*) FILTER (WHERE outcome = 'degenerate') AS fl FROM last_attempts GROUP BY job_id),
plan_counts AS (SELECT job_id, count(*) AS total FROM plan GROUP BY job_id)"""
)

CONF = (
    ATTEMPTS
    + """,
cc AS (
  SELECT a.job_id, a.chunk_idx, sum(k / 100.0::DOUBLE * CASE WHEN k > 0 THEN k ELSE 1 END) AS total,
         sum(CASE WHEN k > 0 THEN k ELSE 1 END)::DOUBLE AS weight
  FROM attempts a JOIN last_attempts l ON l.job_id = a.job_id AND l.chunk_idx = a.chunk_idx AND l.outcome <> 'degenerate'
  WHERE a.outcome = 'ok' GROUP BY ALL)"""
)


def _tables(spark, sf):
    return (
        views.chunk_plan(spark, sf),
        views.done(spark, sf),
        views.failed(spark, sf),
        views.attempts(spark, sf),
    )


def _stages(spark, sf):
    return views.recordings(spark, sf).select(
        F.col("rec_id").alias("job_id"),
        F.lit(2000.0).alias("inference_seconds"),
        F.col("n").cast("double").alias("analysed_seconds"),
    )


@BOOK.add(
    "WITH "
    + SUMMARY
    + """
SELECT p.job_id, p.total AS total_chunks, c.ok AS chunks_ok, c.ns AS chunks_no_speech, c.fl AS chunks_failed,
  round(s.calls * 0.096::DOUBLE, 9) AS audio_seconds_sent, round(s.wall, 9) AS request_seconds_sum,
  round(s.wall / 2000.0::DOUBLE, 9) AS effective_concurrency, round(s.wall / r.n, 9) AS real_time_factor,
  s.calls AS token_calls, s.tokens::DOUBLE AS tokens_sum, s.tmax::DOUBLE AS tokens_max, s.tp95::DOUBLE AS tokens_p95,
  k.chunk_mean, k.chunk_p95, k.chunk_max, s.calls AS attempts, s.fallbacks, 0::BIGINT AS splits
FROM plan_counts p JOIN chunk_counts c USING (job_id) JOIN call_stats s USING (job_id)
JOIN chunk_stats k USING (job_id) JOIN recordings r ON r.rec_id = p.job_id"""
)
def agg_1_execution_summary(spark, sf):
    return rounded(metrics.execution_summary(*_tables(spark, sf), _stages(spark, sf)))


@BOOK.add(
    "WITH " + CONF + " SELECT job_id, chunk_idx, round(total / weight, 9) AS mean, weight FROM cc"
)
def agg_2_chunk_confidence(spark, sf):
    cc = metrics.chunk_confidence(views.done(spark, sf), views.attempts(spark, sf))
    return rounded(cc)


@BOOK.add(
    "WITH "
    + CONF
    + """ SELECT job_id, round(sum(total) / sum(weight), 9) AS mean,
  round(list_sort(list(total / weight)) [greatest(1, CAST(ceil(0.1::DOUBLE * count(*)) AS BIGINT))], 9) AS p10_chunk,
  count(*) FILTER (WHERE total / weight < 0.5) AS low_chunks FROM cc GROUP BY job_id"""
)
def agg_3_confidence_summary(spark, sf):
    return rounded(
        metrics.confidence_summary(
            stage(metrics.chunk_confidence(views.done(spark, sf), views.attempts(spark, sf)))
        )
    )


@BOOK.add(
    """WITH s AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, n, v[greatest(1, CAST(ceil(0.1::DOUBLE * n) AS BIGINT))] AS p10,
  v[greatest(1, CAST(ceil(0.5::DOUBLE * n) AS BIGINT))] AS p50, v[greatest(1, CAST(ceil(0.95::DOUBLE * n) AS BIGINT))] AS p95 FROM s"""
)
def agg_4_percentile_nearest(spark, sf):
    return exact_percentiles(
        views.table(spark, sf, "events"),
        ["event_type"],
        F.col("value"),
        {"p10": (0.1, "nearest"), "p50": (0.5, "nearest"), "p95": (0.95, "nearest")},
    )


@BOOK.add(
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag"""
)
def agg_5_percentile_linear(spark, sf):
    found = exact_percentiles(
        views.table(spark, sf, "lineitem"),
        ["l_returnflag"],
        F.col("l_extendedprice"),
        {"p10": (0.1, "linear"), "p95": (0.95, "linear")},
    )
    return found.select("l_returnflag", "n", F.round("p10", 4).alias("p10"), F.round("p95", 4).alias("p95"))


@BOOK.add(
    """SELECT l_orderkey AS version, stage, round(sum(seconds), 3) AS seconds FROM (
  SELECT l_orderkey, 'preparation' AS stage, CAST(l_quantity AS DECIMAL(18,2)) AS seconds FROM lineitem
  UNION ALL SELECT l_orderkey, 'inference', CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem
  UNION ALL SELECT l_orderkey, 'export', CASE WHEN l_linestatus <> 'O' THEN CAST(l_discount AS DECIMAL(18,2)) END FROM lineitem)
GROUP BY ALL""".replace("round(sum(seconds), 3)", "round(CAST(sum(seconds) AS DOUBLE), 6)")
)
def agg_6_stage_totals(spark, sf):
    return rounded(metrics.stage_totals(views.run_stages(spark, sf), ["version"]), 6)


@BOOK.add(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: exp(least(0.0::DOUBLE, x::DOUBLE)))) / len(embedding), 9) AS mean_token_prob,
  round(list_min(list_transform(embedding, lambda x: exp(least(0.0::DOUBLE, x::DOUBLE)))), 9) AS min_token_prob,
  len(embedding)::BIGINT AS logprob_tokens FROM embeddings"""
)
def agg_8_token_profile(spark, sf):
    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return rounded(metrics.token_profile(vectors, "embedding").drop("embedding"))


@BOOK.add(
    "WITH "
    + SEGMENTS
    + """ SELECT job_id, seg_idx, greatest(1, least(1024, CAST(ceil(48.0::DOUBLE + 8.0::DOUBLE * greatest(0.0::DOUBLE, (start_s + len_s) - start_s)) AS BIGINT))) AS max_tokens
FROM segments"""
)
def col_6_request_budget(spark, sf):
    return views.segments(spark, sf).select(
        "job_id", "seg_idx", request_budget(F.col("start"), F.col("end"), 1024, 48, 8.0).alias("max_tokens")
    )


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """, f AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, chunk_idx ORDER BY attempt_no DESC) AS r,
    CASE WHEN finish_reason = 'length' THEN 'length' WHEN error LIKE '%repetition loop%' THEN 'loop'
         WHEN error LIKE '%instruction prompt%' THEN 'prompt_echo' ELSE 'invalid' END AS reason FROM attempts)
SELECT job_id, chunk_idx, count(*) AS calls,
  max(CASE WHEN r = 1 THEN CASE WHEN outcome = 'degenerate' THEN 'failed' ELSE outcome END END) AS outcome,
  max(CASE WHEN r = 1 AND outcome <> 'degenerate' THEN stage END) AS winning_stage,
  max(CASE WHEN r = 1 AND outcome = 'degenerate' THEN reason END) AS reason
FROM f GROUP BY job_id, chunk_idx"""
)
def udf_4_ladder_resolution(spark, sf):
    return metrics.ladder_resolution(views.attempts(spark, sf))


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """, e AS (
  SELECT job_id, chunk_idx, count(*) AS entries, arg_max(outcome || ': ' || error, attempt_no) FILTER (WHERE error IS NOT NULL) AS err
  FROM attempts GROUP BY ALL)
SELECT l.job_id, row_number() OVER (PARTITION BY l.job_id ORDER BY l.chunk_idx) - 1 AS gap_no, l.chunk_idx,
  round(l.chunk_idx * 0.096::DOUBLE, 6) AS start_s, round(l.chunk_idx * 0.096::DOUBLE + 0.096::DOUBLE, 6) AS end_s, e.entries, e.err AS error
FROM last_attempts l JOIN e USING (job_id, chunk_idx) WHERE l.outcome = 'degenerate'"""
)
def agg_15_gap_report(spark, sf):
    gaps = metrics.gap_report(views.failed(spark, sf), views.attempts(spark, sf))
    return gaps.select(
        "job_id", "gap_no", "chunk_idx", F.round("start", 6).alias("start_s"),
        F.round("end", 6).alias("end_s"), "entries", "error",
    )


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """ SELECT job_id, chunk_idx, count(*) AS entries, count(*) FILTER (WHERE outcome <> 'ok') AS not_ok
FROM attempts GROUP BY ALL HAVING count(*) > 1 OR count(*) FILTER (WHERE outcome <> 'ok') > 0"""
)
def agg_15_notable_histories(spark, sf):
    return metrics.notable_histories(views.attempts(spark, sf))


def _finished(spark, sf):
    from ..operators.ordered import running

    events = views.attempts_events(spark, sf)
    timed = running(
        events, ["user_id"], ["frame_idx"], F.floor(F.col("frame_idx") / 65536), {"cents": ("sum", F.col("value_cents"))}
    )
    kind = F.col("event_type")
    return timed.select(
        F.col("user_id").alias("job_id"),
        (F.col("frame_idx") + 1).alias("seq"),
        (F.col("cents") / 100.0).alias("elapsed_s"),
        F.when(kind.isin("view", "click", "purchase"), "ok").when(kind == "signup", "no_speech").otherwise("failed").alias("outcome"),
        F.col("k").cast("double").alias("audio_seconds"),
        F.col("k").cast("double").alias("tokens"),
        F.when(kind.isin("view", "click", "purchase"), (F.col("k") * F.col("k")).cast("double")).otherwise(0.0).alias("conf_sum"),
        F.when(kind.isin("view", "click", "purchase"), F.lit(100.0) * F.col("k")).otherwise(0.0).alias("conf_weight"),
    )


@BOOK.add(
    "WITH "
    + EVENTS
    + """, t AS (SELECT user_id AS job_id, count(*) + 3 + user_id % 3 AS total_chunks, sum(k) + 500.0::DOUBLE AS audio_total FROM ev GROUP BY user_id),
f AS (
  SELECT user_id AS job_id, frame_idx + 1 AS seq, sum(CAST(round_even(value * 100, 0) AS BIGINT)) OVER w / 100.0::DOUBLE AS el,
    sum(CASE WHEN event_type IN ('view','click','purchase') THEN 1 ELSE 0 END) OVER w AS ok0,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS ns,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS fl,
    sum(k) OVER w AS audio, sum(CASE WHEN event_type IN ('view','click','purchase') THEN k * k ELSE 0 END) OVER w AS cs,
    sum(CASE WHEN event_type IN ('view','click','purchase') THEN 100 * k ELSE 0 END) OVER w AS cw
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING))
SELECT job_id, seq, (ok0 + job_id % 3)::BIGINT AS ok, ns::BIGINT AS no_speech, fl::BIGINT AS failed,
  (ok0 + job_id % 3 + ns + fl)::BIGINT AS done_chunks, total_chunks::BIGINT AS total_chunks,
  100.0::DOUBLE * (ok0 + job_id % 3 + ns + fl) / total_chunks AS percent,
  (audio + 10 * (job_id % 3))::DOUBLE AS audio_done_s, el AS elapsed_s,
  CASE WHEN el > 0 AND audio > 0 THEN CASE WHEN audio_total - (audio + 10 * (job_id % 3)) <= 0 THEN 0.0::DOUBLE
    ELSE (audio_total - (audio + 10 * (job_id % 3))) / (audio / el::DOUBLE) END END AS eta_s,
  CASE WHEN el > 0 AND audio > 0 THEN 1.0::DOUBLE / (audio / el) END AS real_time_factor,
  CASE WHEN el > 0 AND audio > 0 THEN audio / el END AS throughput_x,
  audio::DOUBLE AS tokens, CASE WHEN cw > 0 THEN cs::DOUBLE / cw END AS confidence_mean
FROM f JOIN t USING (job_id)"""
)
def win_11_progress_series(spark, sf):
    totals = (
        views.attempts_events(spark, sf)
        .groupBy(F.col("user_id").alias("job_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("audio"))
        .select(
            "job_id",
            (F.col("n") + 3 + F.col("job_id") % 3).alias("total_chunks"),
            (F.col("audio") + 500.0).alias("audio_total"),
        )
    )
    seeds = totals.select(
        "job_id",
        (F.col("job_id") % 3).alias("seed_ok"),
        F.lit(0).cast("long").alias("seed_no_speech"),
        (F.lit(10) * (F.col("job_id") % 3)).alias("seed_audio"),
    )
    series = metrics.progress_series(_finished(spark, sf), totals, seeds)
    return series


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + """, c AS (
  SELECT run_id, seq, k % 10 AS chunk_idx, CASE type WHEN 'chunk.started' THEN 'started' ELSE 'finished' END AS kind
  FROM run_events WHERE type IN ('chunk.started', 'chunk.finished')),
d AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY run_id, chunk_idx ORDER BY seq), '') = 'started' AS was FROM c)
SELECT run_id AS job_id, seq, chunk_idx, kind,
  CAST(sum(CASE WHEN kind = 'started' AND NOT was THEN 1 WHEN kind = 'finished' AND was THEN -1 ELSE 0 END)
    OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS in_flight FROM d"""
)
def win_12_in_flight(spark, sf):
    return metrics.in_flight(_chunk_events(spark, sf))


def _chunk_events(spark, sf):
    return (
        views.run_events(spark, sf)
        .where(F.col("type").isin("chunk.started", "chunk.finished"))
        .select(
            F.col("run_id").alias("job_id"),
            "seq",
            (F.col("k") % 10).alias("chunk_idx"),
            F.when(F.col("type") == "chunk.started", "started").otherwise("finished").alias("kind"),
        )
    )


@BOOK.add(
    "WITH "
    + CONF
    + ", "
    + SUMMARY[len(ATTEMPTS) + 2 :]
    + """, rr AS (
  SELECT job_id, round(sum(wall_cents) / 100.0::DOUBLE, 9) AS wall_seconds, strftime(max(ts), '%Y-%m-%d') AS ended, count(*) AS runs
  FROM (SELECT user_id AS job_id, CAST(round_even(value * 100, 0) AS BIGINT) AS wall_cents, ts FROM ev) GROUP BY job_id)
SELECT p.job_id, p.total AS total_chunks, c.ok AS chunks_ok, c.ns AS chunks_no_speech, c.fl AS chunks_failed,
  s.tokens::DOUBLE AS tokens_sum, q.mean AS confidence, rr.wall_seconds, rr.ended, rr.runs, a.artifacts
FROM plan_counts p JOIN chunk_counts c USING (job_id) JOIN call_stats s USING (job_id) JOIN rr USING (job_id)
LEFT JOIN (SELECT job_id, round(sum(total) / sum(weight), 9) AS mean FROM cc GROUP BY job_id) q USING (job_id)
LEFT JOIN (SELECT user_id AS job_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS artifacts FROM ev GROUP BY user_id) a USING (job_id)"""
)
def agg_12_job_rollup(spark, sf):
    events = views.attempts_events(spark, sf)
    summary = metrics.execution_summary(*_tables(spark, sf), _stages(spark, sf))
    confidence = metrics.confidence_summary(
        stage(metrics.chunk_confidence(views.done(spark, sf), views.attempts(spark, sf)))
    )
    runs = events.select(
        F.col("user_id").alias("job_id"),
        (F.col("value_cents") / 100.0).alias("wall_seconds"),
        F.date_format("ts", "yyyy-MM-dd").alias("ended"),
    )
    files = events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("name"))
    return rounded(metrics.job_rollup(summary, confidence, runs, files))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
