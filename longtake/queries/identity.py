"""Queries for identity, skip and resume, contracts, and decisions over listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import identity, selection
from ..plans import views
from ..session import stage
from ..settings import InferenceSettings
from .base import ATTEMPTS, EVENTS, MEDIA, SEGMENTS, SOURCES, VERSIONS, Book, rounded

BOOK = Book()
SMALL_BLOCK = 256
ARTIFACT_NAMES = ", ".join(f"'{n}'" for n in identity.REQUIRED_ARTIFACTS)

KEYED = (
    SOURCES
    + """,
keyed AS (SELECT *, substr(sha256(encode(size || ':') || content || content), 1, 12) AS source_key FROM sources)"""
)


def _stem_sql(name: str) -> str:
    base = f"regexp_replace(regexp_extract({name}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
    return f"regexp_replace(regexp_replace({base}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"


@BOOK.add(
    "WITH "
    + KEYED
    + f" SELECT doc_id, name, size, source, source_key, {_stem_sql('name')} AS stem, {_stem_sql('name')} || '-' || source_key AS folder FROM keyed"
)
def col_1_identity(spark, sf):
    return identity.identify(views.sources(spark, sf))


@BOOK.add(
    "WITH "
    + SOURCES
    + """ SELECT doc_id, substr(sha256(encode(size || ':') || content[1:256] || content[greatest(1, size - 255):size]), 1, 12) AS source_key FROM sources"""
)
def col_1_identity_small_block(spark, sf):
    found = identity.identify(views.sources(spark, sf), SMALL_BLOCK)
    return found.select("doc_id", "source_key")


@BOOK.add(
    "WITH "
    + KEYED
    + " SELECT source_key, count(*) AS copies, min(name) AS first_name FROM keyed GROUP BY source_key HAVING count(*) > 1"
)
def col_1_duplicates(spark, sf):
    return identity.duplicates(identity.identify(views.sources(spark, sf)))


VERSION_NAMES = (
    VERSIONS
    + """,
named AS (
  SELECT version, source, strftime(created, '%Y%m%dT%H%MZ') || '_' || lower(replace(replace(model, ' ', '-'), '--', '-')) || '_'
    || CASE version % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'first' || (version % 900 + 1) || 's'
       WHEN 2 THEN 'from' || (version % 60 + 1) || 'p5s-rest' ELSE 'Broken' END
    || '_' || substr(sha256(CAST(version AS VARCHAR)), 1, 8) AS name FROM versions)"""
)


def _version_names(spark, sf):
    v = views.versions(spark, sf)
    n = F.col("version")
    span = F.when(n % 4 == 1, (n % 900 + 1).cast("double")).cast("double")
    begin = F.when(n % 4 == 2, n % 60 + 1.5).otherwise(0.0)
    name = identity.version_name(
        F.col("created"), F.col("model"), span, F.sha2(n.cast("string"), 256), begin
    )
    return v.select(
        "version",
        "source",
        F.when(n % 4 == 3, F.regexp_replace(name, "_full_", "_Broken_")).otherwise(name).alias("name"),
    )


@BOOK.add("WITH " + VERSION_NAMES + " SELECT version, source, name FROM named")
def col_1_version_name(spark, sf):
    return _version_names(spark, sf)


@BOOK.add(
    "WITH "
    + VERSION_NAMES
    + r""" SELECT version, source, name,
  CASE WHEN version % 4 <> 3 THEN strftime(strptime(regexp_extract(name, '^(\d{8}T\d{4})Z', 1), '%Y%m%dT%H%M'), '%Y-%m-%d %H:%M') END AS created,
  CASE WHEN version % 4 <> 3 THEN split_part(name, '_', 2) END AS model_slug,
  CASE WHEN version % 4 <> 3 THEN split_part(name, '_', 3) END AS scope,
  CASE WHEN version % 4 <> 3 THEN split_part(name, '_', 4) END AS fingerprint_prefix,
  CASE WHEN version % 4 = 2 THEN (version % 60 + 1) + 0.5::DOUBLE END AS start_seconds,
  CASE WHEN version % 4 = 1 THEN (version % 900 + 1)::DOUBLE END AS max_seconds FROM named"""
)
def col_2_parse_versions(spark, sf):
    return identity.parse_versions(_version_names(spark, sf))


PENDING = (
    KEYED
    + f""",
arts AS (SELECT doc_id AS version, unnest([{ARTIFACT_NAMES}]) AS name, size FROM keyed),
whole AS (SELECT version FROM arts WHERE NOT (size < 500 AND name = 'report.json') GROUP BY version HAVING count(DISTINCT name) = 6),
finished AS (
  SELECT DISTINCT k.source_key, k.doc_id % 2 AS fp FROM keyed k JOIN whole w ON w.version = k.doc_id WHERE k.size <= 4000)"""
)


def _pending_inputs(spark, sf):
    keyed = identity.identify(views.sources(spark, sf)).select(
        "doc_id", "source_key", "size", (F.col("doc_id") % 2).alias("fingerprint")
    )
    versions = keyed.select(
        F.col("doc_id").alias("version"),
        "source_key",
        "fingerprint",
        F.when(F.col("size") > 4000, "incomplete").otherwise("completed").alias("status"),
    )
    artifacts = keyed.select(
        F.col("doc_id").alias("version"),
        "size",
        F.explode(F.array(*[F.lit(n) for n in identity.REQUIRED_ARTIFACTS])).alias("name"),
    ).where(~((F.col("size") < 500) & (F.col("name") == "report.json")))
    return keyed, versions, artifacts


@BOOK.add(
    "WITH "
    + PENDING
    + """ SELECT k.source_key, k.doc_id % 2 AS fingerprint, k.doc_id FROM keyed k
WHERE NOT EXISTS (SELECT 1 FROM finished f WHERE f.source_key = k.source_key AND f.fp = k.doc_id % 2)"""
)
def join_1_pending_sources(spark, sf):
    return identity.pending_sources(*_pending_inputs(spark, sf)).select("source_key", "fingerprint", "doc_id")


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """ SELECT p.job_id, p.chunk_idx FROM plan p
LEFT JOIN last_attempts l ON l.job_id = p.job_id AND l.chunk_idx = p.chunk_idx AND l.outcome <> 'degenerate' WHERE l.job_id IS NULL"""
)
def join_2_pending_chunks(spark, sf):
    return identity.pending_chunks(views.chunk_plan(spark, sf), views.done(spark, sf)).select("job_id", "chunk_idx")


@BOOK.add(
    "WITH " + ATTEMPTS + " SELECT job_id, count(*) AS resumed_chunks FROM last_attempts WHERE outcome <> 'degenerate' GROUP BY job_id"
)
def join_2_resumed_counts(spark, sf):
    return identity.resumed_counts(views.done(spark, sf))


def _legacy(spark, sf):
    """Records whose media is found for every third one only; names repeat within a source."""
    keyed = identity.identify(views.sources(spark, sf))
    records = keyed.select(
        F.col("doc_id").alias("record"), F.col("source").alias("name"), "size", "source_key"
    )
    return records


@BOOK.add(
    "WITH "
    + KEYED
    + """, own AS (SELECT doc_id AS record, source AS name, size, CASE WHEN size > 1000 THEN source_key END AS k FROM keyed),
shared AS (SELECT name, size, arg_max(k, record) AS k FROM own WHERE k IS NOT NULL GROUP BY ALL)
SELECT o.record, o.name, o.size, coalesce(o.k, s.k, substr(sha256('metadata:' || o.size || ':' || o.name), 1, 12)) AS source_key,
  CASE WHEN coalesce(o.k, s.k) IS NOT NULL THEN 'content' ELSE 'metadata' END AS basis
FROM own o LEFT JOIN shared s USING (name, size)"""
)
def join_5_propagate_keys(spark, sf):
    records = _legacy(spark, sf)
    located = records.where(F.col("size") > 1000).select("record", "source_key")
    return identity.propagate_keys(records.drop("source_key"), located)


@BOOK.add(
    "WITH "
    + KEYED
    + """, p AS (SELECT DISTINCT source_key, source AS folder FROM keyed)
SELECT source_key, folder FROM p WHERE source_key IN (SELECT source_key FROM p GROUP BY source_key HAVING count(*) > 1)"""
)
def join_11_ambiguous_keys(spark, sf):
    keyed = identity.identify(views.sources(spark, sf)).select("source_key", F.col("source").alias("folder"))
    return identity.ambiguous(stage(keyed), ["source_key"], "folder")


REKEY = (
    KEYED
    + """,
rec AS (
  SELECT doc_id AS record, source || '.wav' AS name, size, CASE WHEN doc_id % 11 = 0 THEN 'short' ELSE sha256(lang_) END AS fingerprint,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 10:30:00' END AS created,
    CASE WHEN doc_id % 2 = 0 THEN source_key END AS k, doc_id % 17 = 0 AS migrated
  FROM (SELECT keyed.*, CAST(doc_id % 5 AS VARCHAR) AS lang_ FROM keyed)),
shared AS (SELECT name, size, arg_max(k, record) AS k FROM rec WHERE k IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT r.*, CASE WHEN coalesce(r.k, s.k) IS NULL THEN 'metadata' ELSE 'content' END AS basis,
    coalesce(r.k, s.k, substr(sha256('metadata:' || r.size || ':' || r.name), 1, 12)) AS key,
    NOT migrated AND length(fingerprint) >= 8 AND created IS NOT NULL AS usable
  FROM rec r LEFT JOIN shared s USING (name, size)),
folders AS (SELECT source_key, min(source || '.wav-known') AS known FROM keyed WHERE size < 300 GROUP BY source_key),
aimed AS (
  SELECT p.*, CASE WHEN usable THEN coalesce(f.known, regexp_replace(name, '\\.wav$', '') || '-' || key) || '/20240101T1030Z_base-1.5b_full_' || substr(fingerprint, 1, 8) END AS target
  FROM placed p LEFT JOIN folders f ON f.source_key = p.key),
claims AS (SELECT target, min(record) AS claimed_by FROM aimed WHERE usable GROUP BY target),
existing AS (SELECT DISTINCT target FROM aimed WHERE usable AND size > 6000)"""
)


@BOOK.add(
    "WITH "
    + REKEY
    + """ SELECT a.record,
  CASE WHEN migrated THEN 'already-migrated' WHEN NOT usable THEN 'skipped'
       WHEN e.target IS NOT NULL OR c.claimed_by <> a.record THEN 'conflict' ELSE 'move' END AS status,
  a.target, CASE WHEN usable THEN basis END AS basis,
  CASE WHEN migrated THEN 'already a source folder' WHEN length(fingerprint) < 8 THEN 'no fingerprint or source name'
       WHEN created IS NULL THEN 'no usable timestamp'
       WHEN e.target IS NOT NULL OR c.claimed_by <> a.record THEN 'target exists or is claimed'
       WHEN basis = 'metadata' THEN 'key derived from size and name' ELSE '' END AS reason
FROM aimed a LEFT JOIN claims c ON c.target = a.target LEFT JOIN existing e ON e.target = a.target"""
)
def col_11_rekey_plan(spark, sf):
    keyed = stage(identity.identify(views.sources(spark, sf)))
    n = F.col("doc_id")
    records = keyed.select(
        n.alias("record"),
        F.concat("source", F.lit(".wav")).alias("name"),
        "size",
        F.when(n % 11 == 0, "short").otherwise(F.sha2((n % 5).cast("string"), 256)).alias("fingerprint"),
        F.when(n % 13 != 0, F.lit("2024-01-01 10:30:00").cast("timestamp")).alias("created"),
        F.lit("Base 1.5B").alias("model"),
        F.lit(None).cast("double").alias("max_duration"),
        F.when(n % 2 == 0, F.col("source_key")).alias("located_key"),
        (n % 17 == 0).alias("migrated"),
    )
    folders = keyed.where(F.col("size") < 300).select(
        "source_key", F.concat("source", F.lit(".wav-known")).alias("folder")
    )
    nothing = records.select(F.lit("").alias("target")).where(F.lit(False))
    wanted = identity.rekey_plan(records, folders, nothing)
    large = keyed.where(F.col("size") > 6000).select(n.alias("record"))
    targets = wanted.where(F.col("target").isNotNull()).join(large, "record", "left_semi").select("target")
    return identity.rekey_plan(records, folders, stage(targets))


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """, t AS (
  SELECT job_id, chunk_idx, 'plan' AS kind FROM attempts WHERE outcome = 'ok'
  UNION ALL SELECT job_id, chunk_idx, 'done' FROM last_attempts WHERE outcome <> 'degenerate'
  UNION ALL SELECT job_id, chunk_idx, 'failed' FROM attempts WHERE outcome = 'degenerate'
  UNION ALL SELECT job_id, chunk_idx, 'attempts' FROM attempts),
f AS (SELECT job_id, chunk_idx, bool_or(kind = 'plan') AS p, bool_or(kind = 'done') AS d, bool_or(kind = 'failed') AS f, bool_or(kind = 'attempts') AS a FROM t GROUP BY ALL)
SELECT job_id, chunk_idx, problem FROM (
  SELECT job_id, chunk_idx, 'done outside the plan' AS problem FROM f WHERE d AND NOT p
  UNION ALL SELECT job_id, chunk_idx, 'failed outside the plan' FROM f WHERE f AND NOT p
  UNION ALL SELECT job_id, chunk_idx, 'attempts outside the plan' FROM f WHERE a AND NOT p
  UNION ALL SELECT job_id, chunk_idx, 'done and failed' FROM f WHERE d AND f)"""
)
def join_10_key_violations(spark, sf):
    """Planned is what was ever ok, failed what was ever degenerate: every rule is broken."""
    attempts = views.attempts(spark, sf)
    return identity.key_violations(
        attempts.where(F.col("outcome") == "ok"),
        views.done(spark, sf),
        attempts.where(F.col("outcome") == "degenerate"),
        attempts,
    )


CHECKED = (
    SEGMENTS
    + """,
seg AS (
  SELECT job_id, seg_idx AS idx, CASE WHEN (job_id + seg_idx) % 13 = 0 THEN start_s - 2.0::DOUBLE ELSE start_s END AS s,
    CASE WHEN (job_id + seg_idx) % 17 = 0 THEN start_s - 3.0::DOUBLE ELSE start_s + len_s END AS e,
    CASE WHEN (job_id + seg_idx) % 19 = 0 THEN '  ' ELSE text END AS text,
    CASE WHEN job_id % 23 = 0 THEN 20.0::DOUBLE ELSE 100000.0::DOUBLE END AS duration FROM segments),
chk AS (
  SELECT *, lag(e) OVER (PARTITION BY job_id ORDER BY idx) AS pe, lag(idx) OVER (PARTITION BY job_id ORDER BY idx) AS pi FROM seg),
bad AS (
  SELECT job_id, idx, s, e, CASE WHEN s < coalesce(pe, 0) - 1e-6 THEN 'overlaps the span before it' WHEN e <= s THEN 'ends before it starts'
    WHEN s < 0 THEN 'starts before zero' WHEN {extra} END AS problem FROM chk)"""
)


def _suspect_segments(spark, sf):
    n = F.col("job_id") + F.col("seg_idx")
    return views.segments(spark, sf).select(
        "job_id",
        F.col("seg_idx").alias("idx"),
        F.when(n % 13 == 0, F.col("start") - 2.0).otherwise(F.col("start")).alias("start"),
        F.when(n % 17 == 0, F.col("start") - 3.0).otherwise(F.col("end")).alias("end"),
        F.when(n % 19 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("job_id") % 23 == 0, 20.0).otherwise(100000.0).alias("duration"),
    )


@BOOK.add(
    "WITH "
    + CHECKED.format(
        extra="e > duration + 1e-6 THEN 'ends after the recording' WHEN trim(text) = '' THEN 'text is blank'"
    )
    + " SELECT job_id, idx, round(s, 6) AS start_s, round(e, 6) AS end_s, problem FROM bad"
)
def win_9_check_export(spark, sf):
    checked = identity.check_spans(_suspect_segments(spark, sf), "export")
    return checked.select("job_id", "idx", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "problem")


@BOOK.add(
    "WITH "
    + CHECKED.format(
        extra="idx <> coalesce(pi, -1) + 1 THEN 'index is not contiguous' WHEN e > duration + 0.05 THEN 'ends after the recording'"
    )
    + " SELECT job_id, count(*) AS spans, count(problem) AS broken, bool_and(problem IS NULL) AS accepted FROM bad GROUP BY job_id"
)
def win_9_accepted_plans(spark, sf):
    return identity.accepted_documents(identity.check_spans(_suspect_segments(spark, sf), "plan"))


@BOOK.add(
    "WITH "
    + CHECKED.format(extra="FALSE THEN ''")
    + """, par AS (SELECT *, CASE WHEN job_id % 5 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS p0, 60.0::DOUBLE AS p1 FROM chk)
SELECT job_id, idx, CASE WHEN s < coalesce(pe, p0) - 1e-6 THEN 'overlaps the span before it' WHEN e <= s THEN 'ends before it starts'
  WHEN s < p0 - 1e-6 THEN 'starts before its chunk' WHEN e > p1 + 1e-6 THEN 'ends after its chunk'
  WHEN trim(text) = '' THEN 'text is blank' END AS problem FROM par"""
)
def win_9_check_checkpoint(spark, sf):
    nested = _suspect_segments(spark, sf).select(
        "*",
        F.lit(0).cast("long").alias("chunk_idx"),
        F.when(F.col("job_id") % 5 == 0, 5.0).otherwise(0.0).alias("parent_start"),
        F.lit(60.0).alias("parent_end"),
    )
    return identity.check_spans(nested, "checkpoint").select("job_id", "idx", "problem")


@BOOK.add("SELECT source AS folder FROM documents UNION SELECT event_type FROM events UNION SELECT role FROM conversations")
def set_1_known_folders(spark, sf):
    return identity.known_in_any(
        views.table(spark, sf, "documents").select(F.col("source").alias("folder")),
        views.table(spark, sf, "events").select(F.col("event_type").alias("folder")),
        views.table(spark, sf, "conversations").select(F.col("role").alias("folder")),
    )


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """ SELECT job_id, chunk_idx, 'unplanned' AS side FROM (SELECT DISTINCT job_id, chunk_idx FROM attempts EXCEPT SELECT job_id, chunk_idx FROM last_attempts WHERE outcome = 'ok')
UNION ALL SELECT job_id, chunk_idx, 'planned' FROM (SELECT job_id, chunk_idx FROM attempts INTERSECT SELECT job_id, chunk_idx FROM last_attempts WHERE outcome = 'ok')"""
)
def set_2_contract_sets(spark, sf):
    seen = views.attempts(spark, sf).select("job_id", "chunk_idx")
    planned = views.last_attempts(spark, sf).where(F.col("outcome") == "ok").select("job_id", "chunk_idx")
    return (
        seen.subtract(planned).withColumn("side", F.lit("unplanned"))
        .unionByName(seen.intersect(planned).withColumn("side", F.lit("planned")))
    )


@BOOK.add(
    """WITH e AS (SELECT DISTINCT o_custkey AS job_id, o_orderpriority AS name FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT DISTINCT o_custkey AS job_id, o_orderpriority AS name FROM orders WHERE o_orderstatus <> 'F')
SELECT coalesce(e.job_id, a.job_id) AS job_id, coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' ELSE 'unexpected' END AS state
FROM e FULL JOIN a ON a.job_id = e.job_id AND a.name = e.name WHERE a.name IS NULL OR e.name IS NULL"""
)
def set_3_file_sets(spark, sf):
    """Both sides read all orders: files are expected of those begun, and there for those not over."""
    o = views.table(spark, sf, "orders")
    files = lambda df: df.select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("name"))
    return identity.file_set_difference(
        files(o.where(F.col("o_orderstatus") != "P")), files(o.where(F.col("o_orderstatus") != "F"))
    )


@BOOK.add(
    """WITH p AS (
  SELECT doc_id AS job_id, CASE WHEN doc_id % 2 = 0 THEN 'report.json' ELSE 'transcript.txt' END AS name,
    CASE WHEN doc_id % 29 = 0 THEN 0 ELSE n_chars END AS size,
    CASE WHEN doc_id % 6 = 0 THEN '{"n": 1}' WHEN doc_id % 6 = 2 THEN '{"n": ' ELSE '[]' END AS content FROM documents WHERE lang <> 'es'),
c AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 2 = 0 THEN 'report.json' ELSE 'transcript.txt' END AS name,
    CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE lang <> 'fr'),
b AS (SELECT coalesce(p.job_id, c.job_id) AS job_id, coalesce(p.name, c.name) AS name, p.size, c.size AS cs, p.content
  FROM p FULL JOIN c ON p.job_id = c.job_id AND p.name = c.name)
SELECT job_id, name, size,
  CASE WHEN size IS NULL THEN 'missing' WHEN size = 0 THEN 'problem' WHEN cs <> size THEN 'problem'
       WHEN name LIKE '%.json' AND NOT json_valid(content) THEN 'problem' ELSE 'complete' END AS state,
  CASE WHEN size IS NULL THEN 'not published' WHEN size = 0 THEN 'empty' WHEN cs <> size THEN 'differs in size'
       WHEN name LIKE '%.json' AND NOT json_valid(content) THEN 'not valid JSON' WHEN cs IS NOT NULL THEN 'matches the canonical copy' ELSE 'present' END AS note
FROM b"""
)
def join_9_verify_artifacts(spark, sf):
    """All documents: one language is not published yet, one has no canonical copy."""
    d = views.table(spark, sf, "documents")
    n = F.col("doc_id")
    name = F.when(n % 2 == 0, "report.json").otherwise("transcript.txt").alias("name")
    public = d.where(F.col("lang") != "es").select(
        n.alias("job_id"),
        name,
        F.when(n % 29 == 0, 0).otherwise(F.col("n_chars")).alias("size"),
        F.when(n % 6 == 0, '{"n": 1}').when(n % 6 == 2, '{"n": ').otherwise("[]").alias("content"),
    )
    canonical = d.where(F.col("lang") != "fr").select(
        n.alias("job_id"), name, F.when(n % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size")
    )
    return identity.verify_artifacts(public, canonical)


@BOOK.add(
    """SELECT doc_id, '{"backend":"mock","language":"' || lang || '"}' AS settings FROM documents"""
)
def col_12_provenance(spark, sf):
    struct = identity.provenance(InferenceSettings())
    docs = views.table(spark, sf, "documents").withColumn("provenance", struct)
    return docs.select(
        "doc_id",
        F.to_json(F.struct(F.col("provenance.backend").alias("backend"), F.col("lang").alias("language"))).alias("settings"),
    )


# --- decisions ------------------------------------------------------------------------------


@BOOK.add(
    """WITH r AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE k / 10.0::DOUBLE END AS s,
    CASE WHEN k % 4 = 0 THEN value ELSE k / 5.0::DOUBLE END AS e, value AS d FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events)),
v AS (SELECT *, s >= 0 AND s < e AND e <= d + 0.001 AND e - s >= 0.05 AS ok FROM r)
SELECT event_id, ok AS valid, round(CASE WHEN ok THEN least(e, d) END, 6) AS selected_end, round(CASE WHEN ok THEN least(e, d) - s END, 6) AS selected_seconds,
  CASE WHEN ok THEN CASE WHEN s = 0 AND abs(least(e, d) - d) < 0.001 THEN 'full' ELSE 'bounded' END END AS scope FROM v"""
)
def flt_1_select_interval(spark, sf):
    e = views.attempts_events(spark, sf)
    k = F.col("k")
    requests = e.select(
        "event_id",
        F.when(k % 4 == 0, 0.0).otherwise(k / 10.0).alias("start"),
        F.when(k % 4 == 0, F.col("value")).otherwise(k / 5.0).alias("end"),
        F.col("value").alias("duration"),
    )
    return rounded(
        selection.select_interval(requests).select("event_id", "valid", "selected_end", "selected_seconds", "scope"), 6
    )


@BOOK.add(
    "WITH "
    + SEGMENTS
    + """ SELECT job_id, seg_idx, round(greatest(start_s, 10.0::DOUBLE) - 10.0::DOUBLE, 6) AS start_s, round(least(start_s + len_s, 40.0::DOUBLE) - 10.0::DOUBLE, 6) AS end_s
FROM segments WHERE start_s + len_s > 10.0::DOUBLE AND start_s < 40.0::DOUBLE"""
)
def flt_1_rebase(spark, sf):
    segments = views.segments(spark, sf)
    chosen = views.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), F.lit(10.0).alias("selected_start"), F.lit(40.0).alias("selected_end")
    ).distinct()
    return selection.rebase(segments, chosen).select(
        "job_id", "seg_idx", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s")
    )


@BOOK.add(
    "WITH " + MEDIA + " SELECT page_id, path, length, CASE WHEN length > 3000 THEN 'larger than the size limit' END AS rejected FROM media"
)
def flt_2_gate_sources(spark, sf):
    return selection.gate_sources(views.media(spark, sf), 3000)


@BOOK.add(
    "WITH " + MEDIA + " SELECT page_id, path, length FROM media ORDER BY lower(path), path LIMIT 100"
)
def top_1_queue_order(spark, sf):
    return selection.queue_order(views.media(spark, sf), 100)


_LINES = """CASE k % 8 WHEN 0 THEN 'Failed ' || event_type WHEN 1 THEN 'chunk FAILED after ladder' WHEN 2 THEN 'attempt -> job fails'
  WHEN 3 THEN 'Could not archive' WHEN 4 THEN 'Skipped a: already completed' WHEN 5 THEN 'Skipped b: too large'
  WHEN 6 THEN 'Backend: cpu (fallback from gpu)' ELSE 'Prepared ' || event_type END"""


def _status_lines(spark, sf):
    k = F.col("k") % 8
    return views.attempts_events(spark, sf).select(
        "event_id",
        F.when(k == 0, F.concat(F.lit("Failed "), F.col("event_type")))
        .when(k == 1, "chunk FAILED after ladder")
        .when(k == 2, "attempt -> job fails")
        .when(k == 3, "Could not archive")
        .when(k == 4, "Skipped a: already completed")
        .when(k == 5, "Skipped b: too large")
        .when(k == 6, "Backend: cpu (fallback from gpu)")
        .otherwise(F.concat(F.lit("Prepared "), F.col("event_type")))
        .alias("line"),
    )


@BOOK.add(
    "WITH "
    + EVENTS
    + f" SELECT event_id, {_LINES} AS line, CASE WHEN k % 8 IN (0, 1, 2) THEN 'error' WHEN k % 8 IN (3, 5, 6) THEN 'warning' ELSE 'info' END AS level FROM ev"
)
def flt_3_classify_level(spark, sf):
    return _status_lines(spark, sf).withColumn("level", fx.classify_level(F.col("line")))


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """ SELECT job_id, chunk_idx, attempt_no, CASE WHEN finish_reason = 'length' THEN 'length' WHEN error LIKE '%repetition loop%' THEN 'loop'
  WHEN error LIKE '%instruction prompt%' THEN 'prompt_echo' ELSE 'invalid' END AS reason FROM attempts WHERE outcome = 'degenerate'"""
)
def flt_4_degenerate_reason(spark, sf):
    bad = views.attempts(spark, sf).where(F.col("outcome") == "degenerate")
    return bad.select(
        "job_id", "chunk_idx", "attempt_no",
        fx.degenerate_reason(F.col("metrics.finish_reason"), F.col("error")).alias("reason"),
    )


@BOOK.add(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN NULL ELSE l_quantity END AS audio,
  l_quantity + l_discount AS source, l_returnflag = 'R' AS bounded FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN audio IS NULL THEN 'duration unavailable' WHEN audio + greatest(1.0::DOUBLE / 16000, 0.05) < source THEN 'only part was processed'
  WHEN bounded THEN 'bounded run' END AS reason FROM l"""
)
def flt_5_retention(spark, sf):
    l = views.table(spark, sf, "lineitem")
    audio = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), None).otherwise(F.col("l_quantity"))
    return l.select(
        "l_orderkey",
        "l_linenumber",
        selection.retention_reason(
            audio, F.col("l_quantity") + F.col("l_discount"), F.lit(16000), F.col("l_returnflag") == "R"
        ).alias("reason"),
    )


@BOOK.add(
    """SELECT l_orderkey, l_linenumber, abs(l_quantity + l_discount * 15 - l_quantity) <= greatest(1.0::DOUBLE, l_quantity * 0.001::DOUBLE) AS covered FROM lineitem"""
)
def flt_6_covers(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        fx.covers(F.col("l_quantity") + F.col("l_discount") * 15, F.col("l_quantity")).alias("covered"),
    )


@BOOK.add("SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS value FROM events")
def flt_7_finite(spark, sf):
    wild = F.when(F.col("value") > 300, float("nan")).when(F.col("value") > 100, float("inf")).otherwise(F.col("value"))
    return views.table(spark, sf, "events").select("event_id", fx.finite(wild).alias("value"))


@BOOK.add(
    "WITH " + VERSIONS + " SELECT CASE WHEN bool_or(status IN ('failed', 'incomplete')) THEN 1 ELSE 0 END AS exit_status, count(*) AS jobs FROM versions"
)
def flt_8_batch_status(spark, sf):
    return selection.batch_status(views.versions(spark, sf))


@BOOK.add(
    "WITH "
    + EVENTS
    + """, r AS (SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN -1.0::DOUBLE WHEN k % 5 = 2 THEN k::DOUBLE ELSE k + 0.25::DOUBLE END AS m,
    CASE WHEN k % 3 = 0 THEN k + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s, k FROM ev),
b AS (SELECT *, CASE WHEN m IS NULL THEN 'full' WHEN m <= 0 THEN 'unknown' WHEN m = floor(m) THEN 'first' || CAST(m AS BIGINT) || 's' ELSE 'first' || replace(CAST(m AS VARCHAR), '.', 'p') || 's' END AS bound FROM r)
SELECT event_id, CASE WHEN m IS NULL AND s = 0 THEN 'full' ELSE 'bounded' END AS kind,
  CASE WHEN s = 0 THEN bound ELSE 'from' || replace(CAST(s AS VARCHAR), '.', 'p') || 's-' || CASE WHEN m IS NULL THEN 'rest' ELSE bound END END AS label FROM b"""
)
def flt_9_scope(spark, sf):
    k = F.col("k")
    limit = F.when(k % 5 == 0, None).when(k % 5 == 1, -1.0).when(k % 5 == 2, k.cast("double")).otherwise(k + 0.25)
    begin = F.when(k % 3 == 0, k + 0.5).otherwise(0.0)
    scoped = views.attempts_events(spark, sf).select("event_id", selection_scope(limit, begin).alias("scope"))
    return scoped.select("event_id", "scope.kind", "scope.label")


selection_scope = fx.scope_struct


@BOOK.add(
    """WITH r AS (SELECT o_orderkey AS job_id, o_custkey % 50 AS p, o_custkey % 70 AS a, o_orderstatus AS st, o_orderkey % 9 = 0 AS del, o_orderkey % 4 AS w FROM orders),
j AS (SELECT *, p % 2 = 0 AS here, a % 3 = 0 AS arch FROM r)
SELECT job_id, CASE WHEN here THEN 'kept' WHEN arch THEN 'archived' WHEN del THEN 'deleted' ELSE 'gone' END AS state,
  CASE WHEN NOT here THEN NULL WHEN w = 3 THEN 'disk was full' WHEN st <> 'F' THEN 'the job did not finish' WHEN w = 2 THEN 'only part was transcribed'
       WHEN w = 1 THEN 'mock output keeps the recording' WHEN job_id % 5 = 0 THEN 'outside the queue folder' ELSE 'archiving was not applied' END AS reason FROM j"""
)
def flt_10_source_outcome(spark, sf):
    o, n = views.table(spark, sf, "orders"), F.col("o_orderkey")
    p, a = F.col("o_custkey") % 50, F.col("o_custkey") % 70
    records = o.select(
        n.alias("job_id"),
        F.concat(F.lit("in/"), p.cast("string")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("incomplete").alias("status"),
        F.concat(F.lit("archive/"), a.cast("string")).alias("archived_path"),
        (n % 9 == 0).alias("deleted"),
        F.when(n % 4 == 3, "disk was full").alias("warning"),
        F.when(n % 4 == 2, "bounded").otherwise("full").alias("scope_kind"),
        F.when(n % 4 == 1, "mock").otherwise("server").alias("backend"),
        (n % 5 != 0).alias("in_queue_root"),
    )
    listing = (
        records.select("path").where(p_even("path", 2)).union(records.select("archived_path").where(p_even("archived_path", 3)))
    )
    return selection.source_outcome(records, listing)


def p_even(column: str, step: int):
    return F.regexp_extract(column, r"/(\d+)$", 1).cast("int") % step == 0


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
