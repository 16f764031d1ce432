"""Queries for the segmentation operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segmentation as seg
from ..plans import views
from ..session import stage
from ..settings import DEFAULT, TIGHT
from .base import FRAMES

RATE = 16000

RUNS = (
    FRAMES
    + """,
cls AS (
  SELECT rec_id, frame_idx, prob, prob < greatest(0.0::DOUBLE, 0.5::DOUBLE - 0.15::DOUBLE) AS low, prob >= 0.5 AS high FROM frames),
isl AS (
  SELECT rec_id, low, min(frame_idx) AS s, count(*) AS len, min(CASE WHEN high THEN frame_idx END) AS fh
  FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY rec_id, low ORDER BY frame_idx) AS g FROM cls)
  GROUP BY rec_id, low, g),
sep AS (
  SELECT *, coalesce(sum(CASE WHEN low AND len >= {end_frames} THEN 1 ELSE 0 END)
    OVER (PARTITION BY rec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece
  FROM isl WHERE NOT low OR len >= {end_frames}),
runs AS (
  SELECT rec_id, min(fh) AS run_start,
         coalesce(max(CASE WHEN low THEN s END), max(CASE WHEN NOT low THEN s + len END)) AS run_end
  FROM sep GROUP BY rec_id, piece HAVING min(fh) IS NOT NULL)"""
)

# Greedy cuts, frame by frame: for every start the next one, then the chain from the run start.
PIECES = """,
dips AS (SELECT rec_id, s AS d0, s + len AS d1 FROM isl WHERE low),
inrun AS (
  SELECT f.rec_id, r.run_start, r.run_end, f.frame_idx AS i, f.prob
  FROM runs r JOIN frames f ON f.rec_id = r.rec_id AND f.frame_idx >= r.run_start AND f.frame_idx < r.run_end
  WHERE r.run_end - r.run_start > {max_frames}),
starts AS (SELECT rec_id, run_start, run_end, i FROM inrun WHERE run_end - i > {max_frames}),
bydip AS (
  SELECT s.rec_id, s.run_start, s.i, max(greatest(d.d0, s.i + 1)) AS cut, max(d.d1) AS nxt
  FROM starts s JOIN dips d ON d.rec_id = s.rec_id AND d.d0 <= s.i + {max_frames} AND d.d1 > s.i + 1
    AND least(d.d1, s.run_end) - greatest(d.d0, s.i + 1) >= {cut_frames}
  GROUP BY ALL),
bymin AS (
  SELECT s.rec_id, s.run_start, s.i, arg_min(f.i, (f.prob, -f.i)) AS cut
  FROM starts s JOIN inrun f ON f.rec_id = s.rec_id AND f.run_start = s.run_start
    AND f.i BETWEEN greatest(s.i + 1, s.i + {max_frames} // 2) AND s.i + {max_frames}
  GROUP BY ALL),
links AS (
  SELECT s.rec_id, s.run_start, s.run_end, s.i, coalesce(d.cut, m.cut) AS cut, coalesce(d.nxt, m.cut) AS nxt
  FROM starts s LEFT JOIN bydip d USING (rec_id, run_start, i) LEFT JOIN bymin m USING (rec_id, run_start, i)),
chain AS (
  SELECT rec_id, run_start, run_end, run_start AS i FROM runs
  UNION ALL
  SELECT c.rec_id, c.run_start, c.run_end, l.nxt FROM chain c JOIN links l USING (rec_id, run_start, i) WHERE l.nxt < c.run_end),
pieces AS (
  SELECT c.rec_id, c.i AS start_frame, coalesce(l.cut, c.run_end) AS end_frame
  FROM chain c LEFT JOIN links l USING (rec_id, run_start, i) WHERE coalesce(l.cut, c.run_end) > c.i)"""

SPANS = """,
spans AS (
  SELECT p.rec_id, p.start_frame, least(p.start_frame * 0.032::DOUBLE, r.total_seconds) AS s,
         least(p.end_frame * 0.032::DOUBLE, r.total_seconds) AS e, r.total_seconds
  FROM pieces p JOIN recordings r USING (rec_id) WHERE p.end_frame - p.start_frame >= {min_frames})"""

PADDED = """,
beside AS (
  SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM spans WINDOW w AS (PARTITION BY rec_id ORDER BY start_frame)),
padded AS (
  SELECT rec_id, start_frame,
    CASE WHEN pe IS NOT NULL AND greatest(0.0::DOUBLE, s - {pad}::DOUBLE) < least(total_seconds, pe + {pad}::DOUBLE) THEN (pe + s) / 2 ELSE greatest(0.0::DOUBLE, s - {pad}::DOUBLE) END AS s,
    CASE WHEN ns IS NOT NULL AND greatest(0.0::DOUBLE, ns - {pad}::DOUBLE) < least(total_seconds, e + {pad}::DOUBLE) THEN (e + ns) / 2 ELSE least(total_seconds, e + {pad}::DOUBLE) END AS e
  FROM beside)"""

MERGED = """,
ord AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_frame) AS i FROM padded),
fold AS (
  SELECT rec_id, i, s AS gs, e AS ge FROM ord WHERE i = 1
  UNION ALL
  SELECT o.rec_id, o.i,
    CASE WHEN o.s - f.ge <= {gap}::DOUBLE AND o.e - f.gs <= {max_chunk}::DOUBLE THEN f.gs ELSE o.s END, o.e
  FROM fold f JOIN ord o ON o.rec_id = f.rec_id AND o.i = f.i + 1),
merged AS (
  SELECT rec_id, gs AS s, least(max(ge), gs + {max_chunk}::DOUBLE) AS e FROM fold GROUP BY rec_id, gs)"""

D = dict(end_frames=4, cut_frames=3, max_frames=456, min_frames=8, pad="0.2", gap="1.0", max_chunk="15.0")
T = dict(end_frames=3, cut_frames=2, max_frames=29, min_frames=2, pad="0.032", gap="0.1", max_chunk="1.0")


def _sql(*parts: str, select: str, p: dict, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + "".join(parts).format(**p) + " " + select


def win_1_speech_runs(spark: SparkSession, sf: str) -> DataFrame:
    return seg.speech_runs(views.frames(spark, sf), views.recordings(spark, sf), DEFAULT)


def win_1_speech_runs_tight(spark: SparkSession, sf: str) -> DataFrame:
    return seg.speech_runs(views.frames(spark, sf), views.recordings(spark, sf), TIGHT)


def _pieces(spark, sf, s):
    f, r = views.frames(spark, sf), views.recordings(spark, sf)
    return seg.split_runs(stage(seg.speech_runs(f, r, s)), f, r, s)


def win_2_split_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, TIGHT)


def _spans(spark, sf, s):
    return stage(seg.runs_to_spans(_pieces(spark, sf, s), views.recordings(spark, sf), s))


def _seconds(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


def win_3_runs_to_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(_spans(spark, sf, TIGHT), "rec_id", "start_frame")


def win_4_pad_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(seg.pad_spans(_spans(spark, sf, TIGHT), TIGHT), "rec_id", "start_frame")


def _padded(spark, sf, s):
    return stage(seg.pad_spans(_spans(spark, sf, s), s))


def win_5_merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(seg.merge_spans(_padded(spark, sf, DEFAULT), DEFAULT), "rec_id")


def win_5_merge_spans_tight(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(seg.merge_spans(_padded(spark, sf, TIGHT), TIGHT), "rec_id")


def win_6_quantise(spark: SparkSession, sf: str) -> DataFrame:
    f, r = views.frames(spark, sf), views.recordings(spark, sf)
    return seg.quantise(seg.plan_spans(f, r, DEFAULT), r, RATE, DEFAULT)


def win_7_fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return seg.fixed_chunks(views.recordings(spark, sf), RATE, 1.0)


def agg_7_prepared_profile(spark: SparkSession, sf: str) -> DataFrame:
    f, r = views.frames(spark, sf), views.recordings(spark, sf)
    profile = seg.prepared_profile(seg.plan_spans(f, r, DEFAULT), r)
    return profile.select(
        "rec_id",
        F.round("total_seconds", 4).alias("total_seconds"),
        "chunks",
        *[
            F.round(c, 4).alias(c)
            for c in ("min_seconds", "avg_seconds", "max_seconds", "speech_seconds", "speech_percent")
        ],
    )


QUERIES = {
    f.__name__: f
    for f in (
        win_1_speech_runs,
        win_1_speech_runs_tight,
        win_2_split_runs,
        win_3_runs_to_spans,
        win_4_pad_spans,
        win_5_merge_spans,
        win_5_merge_spans_tight,
        win_6_quantise,
        win_7_fixed_chunks,
        agg_7_prepared_profile,
    )
}

_SEC = "round(s, 6) AS start_s, round(e, 6) AS end_s"
_ALL = (RUNS, PIECES, SPANS, PADDED, MERGED)

ORACLES = {
    "win_1_speech_runs": _sql(RUNS, select="SELECT rec_id, run_start, run_end FROM runs", p=D),
    "win_1_speech_runs_tight": _sql(RUNS, select="SELECT rec_id, run_start, run_end FROM runs", p=T),
    "win_2_split_runs": _sql(
        RUNS, PIECES, select="SELECT rec_id, start_frame, end_frame FROM pieces", p=T, recursive=True
    ),
    "win_3_runs_to_spans": _sql(
        RUNS, PIECES, SPANS, select=f"SELECT rec_id, start_frame, {_SEC} FROM spans", p=T, recursive=True
    ),
    "win_4_pad_spans": _sql(
        RUNS, PIECES, SPANS, PADDED,
        select=f"SELECT rec_id, start_frame, {_SEC} FROM padded", p=T, recursive=True,
    ),
    "win_5_merge_spans": _sql(*_ALL, select=f"SELECT rec_id, {_SEC} FROM merged", p=D, recursive=True),
    "win_5_merge_spans_tight": _sql(*_ALL, select=f"SELECT rec_id, {_SEC} FROM merged", p=T, recursive=True),
    "win_6_quantise": _sql(
        *_ALL,
        select="""SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY a) - 1 AS chunk_idx,
          a AS start_sample, b AS end_sample FROM (
          SELECT m.rec_id, CAST(round_even(m.s * 16000, 0) AS BIGINT) AS a,
            least(CAST(round_even(m.e * 16000, 0) AS BIGINT), CAST(round_even(m.s * 16000, 0) AS BIGINT) + 240000,
                  CAST(round_even(r.total_seconds * 16000, 0) AS BIGINT)) AS b
          FROM merged m JOIN recordings r USING (rec_id)) WHERE b > a""",
        p=D,
        recursive=True,
    ),
    "win_7_fixed_chunks": "WITH "
    + FRAMES
    + """, c AS (SELECT rec_id, CAST(round_even(total_seconds * 16000, 0) AS BIGINT) AS total FROM recordings),
      i AS (SELECT rec_id, total, unnest(range(0, total, 16000)) AS start_sample FROM c)
      SELECT rec_id, start_sample // 16000 AS chunk_idx, start_sample, least(start_sample + 16000, total) AS end_sample FROM i""",
    "agg_7_prepared_profile": _sql(
        *_ALL,
        select="""SELECT r.rec_id, round(r.total_seconds, 4) AS total_seconds, count(m.s) AS chunks,
          round(min(m.e - m.s), 4) AS min_seconds, round(avg(m.e - m.s), 4) AS avg_seconds,
          round(max(m.e - m.s), 4) AS max_seconds, round(coalesce(sum(m.e - m.s), 0.0::DOUBLE), 4) AS speech_seconds,
          round(100.0::DOUBLE * coalesce(sum(m.e - m.s), 0.0::DOUBLE) / r.total_seconds, 4) AS speech_percent
          FROM recordings r LEFT JOIN merged m USING (rec_id) GROUP BY r.rec_id, r.total_seconds""",
        p=D,
        recursive=True,
    ),
}
