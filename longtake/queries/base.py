"""Shared pieces of the SQL twins: the same views, written once as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double far below any tie, so both engines print the same digits."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


EVENTS = """ev AS (
  SELECT user_id, event_id, ts, event_type, value, CAST(props->>'k' AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
  FROM events)"""

FRAMES = (
    EVENTS
    + """,
frames AS (SELECT user_id AS rec_id, frame_idx, k / 100.0::DOUBLE AS prob FROM ev),
recordings AS (
  SELECT rec_id, 0.032::DOUBLE AS frame_seconds, 0.5::DOUBLE AS threshold,
         count(*) * 0.032::DOUBLE AS total_seconds, count(*) AS n
  FROM frames GROUP BY rec_id)"""
)

ATTEMPTS = (
    FRAMES
    + """,
attempts AS (
  SELECT user_id AS job_id, frame_idx // 3 AS chunk_idx, frame_idx % 3 AS attempt_no,
         CASE WHEN frame_idx % 3 = 0 THEN 'base' ELSE 'temperature' END AS stage,
         CAST(round_even(value * 100, 0) AS BIGINT) AS wall_cents,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'ok'
              WHEN event_type = 'signup' THEN 'no_speech' ELSE 'degenerate' END AS outcome,
         CASE WHEN event_type = 'error' THEN
           CASE WHEN k % 3 = 0 THEN 'chunk looks like a repetition loop'
                WHEN k % 3 = 1 THEN 'chunk repeats the instruction prompt'
                ELSE 'chunk returned no content' END END AS error,
         CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
         k
  FROM ev),
last_attempts AS (
  SELECT job_id, chunk_idx, arg_max(outcome, attempt_no) AS outcome,
         max(CASE WHEN r = 1 THEN error END) AS error
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, chunk_idx ORDER BY attempt_no DESC) AS r FROM attempts)
  GROUP BY job_id, chunk_idx),
plan AS (
  SELECT rec_id AS job_id, unnest(range(0, CAST(ceil(n / 3.0) AS BIGINT) + 1)) AS chunk_idx FROM recordings)"""
)

RUN_EVENTS = """types AS (
  SELECT unnest(['run.started','job.started','stage.started','stage.finished','stage.progress',
    'job.reused','job.prepared','chunk.started','chunk.attempt','chunk.finished','progress',
    'resource.sample','log','warning','job.finished','run.finished']) AS type,
    unnest(range(0, 16)) AS i),
run_events AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id,
         row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS seq,
         ts, (epoch_us(ts) % 86400000000) / 1e6 AS elapsed_s, user_id AS job_id, t.type,
         CAST(props->>'k' AS INTEGER) AS k, value, event_id, event_type
  FROM events JOIN types t ON t.i = CAST(props->>'k' AS INTEGER) % 16)"""

SEGMENTS = """segments AS (
  SELECT conv_id AS job_id, turn AS seg_idx,
         coalesce(sum(greatest(1.0::DOUBLE, length(text) / 15.0::DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS start_s,
         greatest(1.0::DOUBLE, length(text) / 15.0::DOUBLE) AS len_s, text, role AS speaker
  FROM conversations)"""

VERSIONS = """versions AS (
  SELECT o_custkey AS source, o_orderkey AS version,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'incomplete' END AS status,
         o_orderdate AS created, o_orderdate AS updated, o_orderpriority AS model,
         o_totalprice / 1e6 AS rtf, o_totalprice AS duration
  FROM orders)"""

SAMPLES = """samples AS (
  SELECT vec_id AS rec_id, unnest(range(0, len(embedding))) AS pos,
         CAST(least(greatest(round_even(CAST(unnest(embedding) AS DOUBLE) * 32767, 0), -32768), 32767) AS BIGINT) AS value
  FROM embeddings)"""

SOURCES = """sources AS (
  SELECT doc_id, source || '/' || doc_id || '.wav' AS name, encode(text) AS content,
         CAST(octet_length(encode(text)) AS BIGINT) AS size, source FROM documents)"""

MEDIA = r"""media AS (
  SELECT page_id,
         CASE WHEN page_id % 5 = 4 THEN '.hidden/' ELSE '' END
         || regexp_extract(url, '^https?://([^?#]*)', 1)
         || CASE page_id % 5 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' WHEN 2 THEN '.txt' WHEN 3 THEN '.mkv' ELSE '.wav' END AS path,
         CAST(octet_length(encode(html)) AS BIGINT) AS length FROM pages)"""

OBSERVATIONS = (
    EVENTS
    + """,
observations AS (
  SELECT user_id AS path, frame_idx + 1 AS scan, CAST(k // 25 AS BIGINT) AS size, event_type FROM ev)"""
)


class Book:
    """The queries of one module and their SQL twins, filled by a decorator."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(query):
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return register
