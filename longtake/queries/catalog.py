"""Queries for the catalog and for rendering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import catalog, metrics, render
from ..plans import views
from ..session import work_folder, stage
from .base import ATTEMPTS, RUN_EVENTS, SEGMENTS, VERSIONS, Book, rounded

BOOK = Book()


def _reports(spark, sf):
    l = views.table(spark, sf, "lineitem").join(
        views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source")),
        "l_orderkey",
    )
    kind = F.when(F.col("l_returnflag") == "A", "final").when(F.col("l_returnflag") == "R", "private").otherwise("intermediate")
    return (
        l.groupBy("source", F.col("l_orderkey").alias("version"), kind.alias("kind"))
        .agg(
            F.min("l_linestatus").alias("model"),
            F.sum("l_linenumber").cast("long").alias("total_chunks"),
            F.min("l_linenumber").cast("long").alias("completed_chunks"),
        )
    )


REPORTS = """reports AS (
  SELECT o_custkey AS source, l_orderkey AS version, CASE l_returnflag WHEN 'A' THEN 'final' WHEN 'R' THEN 'private' ELSE 'intermediate' END AS kind,
    min(l_linestatus) AS model, sum(l_linenumber)::BIGINT AS total_chunks, min(l_linenumber)::BIGINT AS completed_chunks
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, version ORDER BY CASE kind WHEN 'final' THEN 1 WHEN 'private' THEN 2 ELSE 3 END) AS r FROM reports) WHERE r = 1),
meta AS (SELECT o_custkey AS source, o_orderkey AS version,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN NULL ELSE 'incomplete' END AS status,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS model, CASE WHEN o_orderstatus = 'P' THEN 'cfg' END AS config_model, o_custkey % 40 AS chunk_count
  FROM orders),
joined AS (
  SELECT coalesce(m.source, b.source) AS source, coalesce(m.version, b.version) AS version,
    coalesce(m.status, CASE WHEN b.kind IN ('final', 'private') THEN 'completed' ELSE 'incomplete' END) AS status,
    coalesce(m.model, m.config_model, b.model) AS model,
    CASE WHEN b.kind = 'intermediate' THEN 'intermediate' WHEN b.kind IS NOT NULL THEN 'final' END AS report_kind,
    coalesce(b.total_chunks, m.chunk_count) AS total_chunks, b.total_chunks AS rt, b.completed_chunks AS rd, m.chunk_count
  FROM meta m FULL JOIN best b ON b.source = m.source AND b.version = m.version)"""


def _summary(spark, sf):
    o = views.table(spark, sf, "orders")
    meta = o.select(
        F.col("o_custkey").alias("source"),
        F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "incomplete").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("model"),
        F.when(F.col("o_orderstatus") == "P", "cfg").alias("config_model"),
        F.lit("auto").alias("language"),
        F.col("o_orderdate").alias("created"),
        (F.col("o_custkey") % 40).alias("chunk_count"),
    )
    return catalog.version_summary(meta, _reports(spark, sf))


@BOOK.add("WITH " + REPORTS + " SELECT source, version, status, model, report_kind, total_chunks FROM joined")
def join_3_version_summary(spark, sf):
    return _summary(spark, sf).select("source", "version", "status", "model", "report_kind", "total_chunks")


@BOOK.add(
    "WITH "
    + REPORTS
    + """ SELECT source, version, round(CASE WHEN status = 'completed' THEN 100.0::DOUBLE
  WHEN rt IS NOT NULL AND rd IS NOT NULL THEN CASE WHEN rt > 0 THEN 100.0::DOUBLE * least(rd, rt) / rt END
  WHEN chunk_count > 0 THEN 100.0::DOUBLE * least(version % 50, chunk_count) / chunk_count END, 9) AS completion_percent FROM joined"""
)
def agg_9_completion(spark, sf):
    known = _summary(spark, sf).withColumn("checkpoint_done", F.col("version") % 50)
    return rounded(catalog.completion(known).select("source", "version", "completion_percent"))


@BOOK.add(
    "WITH "
    + VERSIONS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created DESC, updated DESC, version DESC) AS n FROM versions)
SELECT source, max(CASE WHEN n = 1 THEN version END) AS version, max(CASE WHEN n = 1 THEN status END) AS status, max(CASE WHEN n = 1 THEN model END) AS model,
  strftime(max(updated), '%Y-%m-%d') AS last_activity, count(*) AS version_count, arg_max(duration, version) AS duration_seconds FROM r GROUP BY source"""
)
def agg_10_latest_versions(spark, sf):
    return catalog.latest_versions(views.versions(spark, sf)).withColumn(
        "last_activity", F.date_format("last_activity", "yyyy-MM-dd")
    )


@BOOK.add("WITH " + VERSIONS + " SELECT source, model, max(version) AS last_used FROM versions GROUP BY ALL")
def agg_10_source_names(spark, sf):
    return catalog.source_names(views.versions(spark, sf), "model")


@BOOK.add(
    "WITH "
    + VERSIONS
    + " SELECT source, version, row_number() OVER (PARTITION BY source ORDER BY created DESC, updated DESC, version DESC) - 1 AS newest_no FROM versions"
)
def top_2_newest_first(spark, sf):
    return catalog.newest_first(views.versions(spark, sf)).select("source", "version", "newest_no")


ACTIVE = """, act AS (SELECT source, max(updated) AS activity FROM versions GROUP BY source ORDER BY activity DESC, source DESC),
best AS (SELECT rtf FROM versions v JOIN act USING (source) WHERE status = 'completed' AND rtf > 0
  ORDER BY activity DESC, source DESC, created DESC, updated DESC, version DESC LIMIT 1)"""


@BOOK.add(
    "WITH "
    + VERSIONS
    + ACTIVE
    + ", q AS (SELECT event_id, value * 60 AS duration, value * 60 * coalesce((SELECT rtf FROM best), 0.04::DOUBLE) AS e FROM events)"
    + """, r AS (SELECT *, CAST(round_even(e, 0) AS BIGINT) AS w FROM q)
SELECT event_id, e AS estimate_seconds, CASE WHEN e < 0.1 THEN CAST(round_even(e * 1000, 0) AS BIGINT) || ' ms' WHEN e < 59.95 THEN format('{:.1f} s', e)
  WHEN w >= 3600 THEN format('{:d} h {:02d} min {:02d} s', w // 3600, w % 3600 // 60, w % 60) ELSE format('{:d} min {:02d} s', w // 60, w % 60) END AS estimate FROM r"""
)
def agg_11_estimate_queue(spark, sf):
    queue = views.table(spark, sf, "events").select("event_id", (F.col("value") * 60).alias("duration"))
    return catalog.estimate_queue(queue, views.versions(spark, sf)).select("event_id", "estimate_seconds", "estimate")


@BOOK.add(
    "WITH "
    + VERSIONS
    + ACTIVE
    + ", q AS (SELECT sum(CAST(value * 100 AS BIGINT)) AS c, count(*) AS n FROM events) SELECT n AS recordings, round(c / 100.0::DOUBLE * 60 * coalesce((SELECT rtf FROM best), 0.04::DOUBLE), 2) AS estimate_seconds FROM q"
)
def agg_11_estimate_total(spark, sf):
    queue = views.table(spark, sf, "events").select("event_id", (F.col("value") * 60).alias("duration"))
    return rounded(catalog.estimate_total(catalog.estimate_queue(queue, views.versions(spark, sf))), 2)


_CANDIDATES = """WITH s AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 4 END AS size FROM customer),
c AS (SELECT o_custkey AS source, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS pref, o_orderstatus AS kind,
  'p/' || o_orderkey AS path, o_orderpriority <> '1-URGENT' AS present, o_orderkey % 4 AS csize FROM orders),
m AS (SELECT s.source, kind, path, row_number() OVER (PARTITION BY s.source ORDER BY pref, path) AS r FROM s JOIN c USING (source) WHERE present AND (size IS NULL OR size = csize))
SELECT s.source, coalesce(m.kind, 'missing') AS kind, m.path FROM s LEFT JOIN m ON m.source = s.source AND m.r = 1"""


@BOOK.add(_CANDIDATES)
def join_4_locate(spark, sf):
    n = F.col("c_custkey")
    sources = views.table(spark, sf, "customer").select(
        n.alias("source"), F.when(n % 10 != 0, n % 4).alias("size")
    )
    status = F.col("o_orderstatus")
    candidates = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source"),
        F.when(status == "F", 1).when(status == "O", 2).otherwise(3).alias("preference"),
        status.alias("kind"),
        F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"),
        (F.col("o_orderpriority") != "1-URGENT").alias("present"),
        (F.col("o_orderkey") % 4).alias("candidate_size"),
    )
    return catalog.locate(sources, candidates)


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """, d AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY chunk_idx DESC) AS r FROM last_attempts WHERE outcome <> 'degenerate')
SELECT job_id, chunk_idx, round(chunk_idx * 0.096::DOUBLE, 6) AS start_s, CASE WHEN outcome = 'ok' THEN 'speech' ELSE '' END AS text FROM d WHERE r <= 3"""
)
def top_3_recent_texts(spark, sf):
    recent = catalog.recent_texts(views.done(spark, sf), views.chunk_plan(spark, sf))
    return recent.select("job_id", "chunk_idx", F.round("start", 6).alias("start_s"), "text")


@BOOK.add(
    "WITH "
    + VERSIONS
    + " SELECT source, count(*) AS version_count, strftime(max(updated), '%Y-%m-%d') AS last_activity FROM versions GROUP BY source"
)
def snk_4_rebuild_catalog(spark, sf):
    path = f"{work_folder(spark)}/catalog-{uuid.uuid4().hex}"
    catalog.rebuild_catalog(views.versions(spark, sf), path)
    again = catalog.rebuild_catalog(views.versions(spark, sf), path)
    return again.select("source", "version_count", F.date_format("last_activity", "yyyy-MM-dd").alias("last_activity"))


# --- rendering ------------------------------------------------------------------------------


def _transcripts(spark, sf):
    segments = views.segments(spark, sf)
    jobs = segments.groupBy("job_id").agg(F.max("end").alias("duration"))
    return jobs.select(
        "job_id",
        F.when(F.col("job_id") % 3 == 0, "mock").otherwise("server").alias("backend"),
        F.lit("base").alias("model"),
        F.round("duration", 3).alias("duration"),
        F.array(F.lit("first"), F.lit("first")).alias("warnings"),
    )


_CLOCK = "format('{{:02d}}:{{:02d}}:{{:02d}}{sep}{{:03d}}', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000)"
_A, _B = "CAST(round_even(start_s * 1000, 0) AS BIGINT)", "CAST(round_even((start_s + len_s) * 1000, 0) AS BIGINT)"
_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda l: regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda l: l <> '')"
_CUE = f"'[' || speaker || '] ' || array_to_string({_LINES}, chr(10))"


def _block(sep: str, cue: str) -> str:
    return (
        f"n || chr(10) || {_CLOCK.format(sep=sep, ms=_A)} || ' --> ' || {_CLOCK.format(sep=sep, ms=_B)} || chr(10) || {cue} || chr(10) || chr(10)"
    )


CUES = (
    SEGMENTS
    + """,
cues AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) AS n FROM segments),
heads AS (SELECT job_id, max(start_s + len_s) AS duration, CASE WHEN job_id % 3 = 0 THEN 'mock' ELSE 'server' END AS backend FROM cues GROUP BY job_id)"""
)


def _rendered(spark, sf, formats):
    return render.render(_transcripts(spark, sf), views.segments(spark, sf), formats)


@BOOK.add(
    "WITH "
    + CUES
    + f""" SELECT job_id, 'srt' AS format, 'transcript.srt' AS filename, (n - 1) // 1000 AS part_no, string_agg({_block(',', _CUE)}, '' ORDER BY n) AS content FROM cues GROUP BY ALL
UNION ALL SELECT job_id, 'txt', 'transcript.txt', (n - 1) // 1000, string_agg(text || chr(10), '' ORDER BY n) FROM cues GROUP BY ALL"""
)
def col_7_render_srt_txt(spark, sf):
    return _rendered(spark, sf, ["srt", "txt"])


@BOOK.add(
    "WITH "
    + CUES
    + f""" SELECT job_id, 'vtt' AS format, 'transcript.vtt' AS filename, p AS part_no,
  CASE WHEN p = 0 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END || body AS content FROM (SELECT job_id, (n - 1) // 1000 AS p, string_agg({_block('.', f"replace(replace(replace({_CUE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")}, '' ORDER BY n) AS body FROM cues GROUP BY ALL)"""
)
def col_7_render_vtt(spark, sf):
    return _rendered(spark, sf, "vtt")


@BOOK.add(
    "WITH "
    + CUES
    + f""", b AS (SELECT job_id, (n - 1) // 1000 AS part_no, string_agg(chr(10) || '## ' || {_CLOCK.format(sep='.', ms=_A)} || ' – ' || {_CLOCK.format(sep='.', ms=_B)} || chr(10) || chr(10) || text || chr(10), '' ORDER BY n) AS body FROM cues GROUP BY ALL)
SELECT b.job_id, 'md' AS format, 'transcript.md' AS filename, part_no, CASE WHEN part_no = 0 THEN '# Transcript' || chr(10) || chr(10) || 'Backend: ' || backend || chr(10) || 'Model: base' || chr(10) || chr(10)
  || '> first' || chr(10) || '> {render.COARSE}' || chr(10) || CASE WHEN backend = 'mock' THEN '> {render.SYNTHETIC}' || chr(10) ELSE '' END ELSE '' END || body AS content
FROM b JOIN heads USING (job_id)"""
)
def col_7_render_md(spark, sf):
    return _rendered(spark, sf, ["md"])


@BOOK.add(
    "WITH "
    + CUES
    + """ SELECT h.job_id, count(c.n) AS segments, string_agg(c.text, '|' ORDER BY c.n) AS texts, CASE WHEN h.backend = 'mock' THEN 'mock_completed' ELSE 'completed' END AS status
FROM heads h JOIN cues c USING (job_id) GROUP BY h.job_id, h.backend"""
)
def col_7_render_json(spark, sf):
    """The JSON payload and report parsed back, their parts joined in order."""
    rows = _rendered(spark, sf, ["json", "report-json"])

    def whole(kind):
        parts = F.collect_list(F.when(F.col("format") == kind, F.struct("part_no", "content")))
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["content"]), "")

    content = rows.groupBy("job_id").agg(whole("json").alias("payload"), whole("report-json").alias("report"))
    parsed = F.from_json("payload", "segments array<struct<text:string>>").getField("segments")
    return content.select(
        "job_id",
        F.size(parsed).cast("long").alias("segments"),
        F.array_join(F.transform(parsed, lambda x: x["text"]), "|").alias("texts"),
        F.get_json_object("report", "$.status").alias("status"),
    )


@BOOK.add(
    "WITH "
    + CUES
    + f" SELECT job_id, array_to_string(list_concat(['first'], ['{render.COARSE}'], CASE WHEN backend = 'mock' THEN ['{render.SYNTHETIC}'] ELSE [] END), '|') AS warnings FROM heads"
)
def agg_16_warnings(spark, sf):
    warned = render.warnings_for(_transcripts(spark, sf), views.segments(spark, sf))
    return warned.select("job_id", F.array_join("warnings", "|").alias("warnings"))


@BOOK.add("WITH " + CUES + " SELECT job_id, f.format, count(DISTINCT (n - 1) // 1000) AS parts FROM cues, (SELECT unnest(['txt', 'srt']) AS format) f GROUP BY ALL")
def snk_3_publish(spark, sf):
    path = f"{work_folder(spark)}/published-{uuid.uuid4().hex}"
    render.write_transcripts(_rendered(spark, sf, ["md", "srt", "txt"]), "srt, txt", path)
    return (
        spark.read.parquet(path)
        .groupBy("job_id", "format")
        .agg(F.count_distinct("part_no").alias("parts"))
    )


@BOOK.add(
    "WITH "
    + CUES
    + f""" SELECT job_id, 'srt' AS format, sha256(string_agg({_block(',', _CUE)}, '' ORDER BY n)) AS content_sha256 FROM cues GROUP BY ALL
UNION ALL SELECT job_id, 'txt', sha256(string_agg(text || chr(10), '' ORDER BY n)) FROM cues GROUP BY ALL"""
)
def snk_3_publish_content(spark, sf):
    """Whole files as they are read back: the parts of each, joined in order."""
    path = f"{work_folder(spark)}/published-{uuid.uuid4().hex}"
    render.write_transcripts(_rendered(spark, sf, ["md", "srt", "txt"]), "srt, txt", path)
    parts = F.sort_array(F.collect_list(F.struct("part_no", "content")))
    whole = spark.read.parquet(path).groupBy("job_id", "format").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "").alias("content"))
    return whole.select("job_id", "format", F.sha2("content", 256).alias("content_sha256"))


@BOOK.add(
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice / 20.0::DOUBLE AS s FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_discount FROM lineitem),
r AS (SELECT *, CAST(round_even(s, 0) AS BIGINT) AS w FROM d),
t AS (SELECT *, CASE WHEN s < 0.1 THEN CAST(round_even(s * 1000, 0) AS BIGINT) || ' ms' WHEN s < 59.95 THEN format('{:.1f} s', s)
  WHEN w >= 3600 THEN format('{:d} h {:02d} min {:02d} s', w // 3600, w % 3600 // 60, w % 60) ELSE format('{:d} min {:02d} s', w // 60, w % 60) END AS human FROM r)
SELECT l_orderkey, l_linenumber, human, CASE WHEN human LIKE '% ms' OR human = format('{:.1f} s', s) THEN human ELSE human || ' (' || format('{:.1f} s', s) || ')' END AS timing FROM t"""
)
def col_8_duration_text(spark, sf):
    l = views.table(spark, sf, "lineitem")
    both = l.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 20.0).alias("s")).unionByName(
        l.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("s"))
    )
    return both.select(
        "l_orderkey", "l_linenumber", fx.duration_text(F.col("s")).alias("human"), fx.timing_text(F.col("s")).alias("timing")
    )


@BOOK.add(
    """WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 4 ELSE 3 END AS stages, o_orderstatus FROM orders)
SELECT job_id, CASE o_orderstatus WHEN 'F' THEN 24 ELSE 26 END::BIGINT AS lines, '- Completion: ' || CASE o_orderstatus WHEN 'F' THEN '100%' ELSE 'unknown' END AS completion FROM j"""
)
def col_8_run_report(spark, sf):
    o = views.table(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    versions = o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("version"),
        F.lit("base").alias("model"),
        F.when(done, "completed").otherwise("incomplete").alias("status"),
        F.when(done, 100.0).alias("completion_percent"),
        F.col("o_totalprice").alias("total_wall"),
        F.create_map(
            F.lit("preparation"), F.lit(10.0), F.lit("inference"), F.col("o_totalprice"),
            F.lit("speech_detection"), F.when(done, 4.0), F.lit("export"), F.lit(0.04),
        ).alias("stages_seconds"),
        F.col("o_totalprice").alias("analysed_seconds"),
        F.lit(0.05).alias("real_time_factor"),
        F.lit(10).alias("total_chunks"), F.lit(9).alias("chunks_ok"), F.lit(1).alias("chunks_no_speech"), F.lit(0).alias("chunks_failed"),
        F.lit(None).cast("string").alias("error"),
    )
    lines = render.run_report(versions)
    return lines.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(F.when(F.col("line").startswith("- Completion"), F.col("line"))).alias("completion"),
    )


@BOOK.add(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_totalprice / 1000.0::DOUBLE AS s FROM orders),
t AS (SELECT *, CAST(round_even(s, 0) AS BIGINT) AS w FROM r)
SELECT o_custkey AS job_id, n AS line_no, '| ' || strftime(o_orderdate, '%Y-%m-%d') || ' | in progress | '
  || CASE WHEN s < 0.1 THEN CAST(round_even(s * 1000, 0) AS BIGINT) || ' ms' WHEN s < 59.95 THEN format('{:.1f} s', s) ELSE format('{:d} min {:02d} s', w // 60, w % 60) || ' (' || format('{:.1f} s', s) || ')' END
  || ' | ' || o_orderstatus || ' |' AS line FROM t"""
)
def col_8_run_rows(spark, sf):
    o = views.table(spark, sf, "orders")
    runs = o.select(
        F.col("o_custkey").alias("job_id"),
        F.col("o_orderkey").alias("run_no"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("started"),
        F.lit(None).cast("string").alias("ended"),
        (F.col("o_totalprice") / 1000.0).alias("wall_seconds"),
        F.col("o_orderstatus").alias("status"),
    )
    return render.run_rows(runs)


@BOOK.add(
    """WITH t AS (SELECT *, o_totalprice / 20000.0::DOUBLE AS s FROM orders)
SELECT o_orderkey AS version, 'Timings: total ' || CASE WHEN s < 0.1 THEN CAST(round_even(s * 1000, 0) AS BIGINT) || ' ms' ELSE format('{:.1f} s', s) END
  || CASE WHEN o_orderstatus = 'F' THEN ' | preparation 2.5 s' ELSE '' END || ' | inference 10.0 s' AS line FROM t"""
)
def col_8_timings_line(spark, sf):
    o = views.table(spark, sf, "orders")
    stages = F.create_map(
        F.lit("preparation"), F.when(F.col("o_orderstatus") == "F", 2.5), F.lit("inference"), F.lit(10.0)
    )
    return o.select(
        F.col("o_orderkey").alias("version"),
        render.timings_line(F.col("o_totalprice") / 20000.0, stages).alias("line"),
    )


@BOOK.add(
    """SELECT o_orderkey AS job_id, o_orderstatus || ' | ' || o_orderkey || ' | chunks ok=3 no_speech=1 failed=0 of 4' || CASE WHEN o_orderstatus = 'P' THEN ' | error: disk full' ELSE '' END AS line FROM orders"""
)
def agg_12_summary_lines(spark, sf):
    o = views.table(spark, sf, "orders")
    rollup = o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderstatus").alias("status"),
        F.lit(4).alias("total_chunks"),
        F.lit(3).alias("chunks_ok"),
        F.lit(1).alias("chunks_no_speech"),
        F.lit(0).alias("chunks_failed"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("double").alias("wall_seconds"),
        F.when(F.col("o_orderstatus") == "P", "disk full").alias("error"),
    )
    return metrics.summary_lines(rollup)


@BOOK.add(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 200 THEN f ELSE substr(f, 1, 199) || '...' END AS message FROM t"""
)
def col_10_short_message(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", fx.short_message(F.col("text")).alias("message"))


@BOOK.add(
    "WITH "
    + RUN_EVENTS
    + """ SELECT run_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE type WHEN 'log' THEN '[' || event_type || '] message ' || k WHEN 'warning' THEN '[warning] message ' || k
  WHEN 'run.started' THEN '[run] started ' || run_id || ': command=None model=base backend=None queue=' || k ELSE '[run] finished: exit=' || k || ' wall=Nones' END AS line
FROM run_events WHERE type IN ('log', 'warning', 'run.started', 'run.finished')"""
)
def snk_2_run_log(spark, sf):
    k = F.col("k")
    events = views.run_events(spark, sf).select(
        "run_id",
        "seq",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "type",
        F.to_json(
            F.struct(
                F.col("event_type").alias("level"),
                F.concat(F.lit("message "), k.cast("string")).alias("message"),
                F.lit("base").alias("model"),
                k.alias("queue_size"),
                k.alias("exit_status"),
            )
        ).alias("data"),
    )
    return render.run_log(events)


@BOOK.add("WITH " + SEGMENTS + " SELECT job_id, seg_idx, row_number() OVER (PARTITION BY job_id ORDER BY start_s, start_s + len_s) - 1 AS position FROM segments")
def top_4_transcript_order(spark, sf):
    return render.transcript_order(views.segments(spark, sf)).select("job_id", "seg_idx", "position")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
