"""Queries that run user functions: scorers, transcribers and the recovery ladder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answers, export, recovery, signal
from ..operators.ordered import numbered
from ..plans import views
from ..session import stage, work_folder
from ..settings import InferenceSettings
from ..streaming import jobs
from .base import ATTEMPTS, Book

BOOK = Book()
SETTINGS = InferenceSettings(prompt="Transcribe the audio.", retries=1)
QUICK = 4096  # chunks of one task where a call takes microseconds


def scripted():
    """A model whose answers follow from the chunk's number alone.

    ``(job + chunk) % 6`` says how far the ladder has to go: 0 base, 1 and 2 the fallback
    temperatures, 3 the call without context, 4 a split, 5 nothing helps.
    """

    def model(call: recovery.Call):
        n = (int(call.job_id) + int(call.chunk_idx)) % 6
        call.metrics["completion_tokens"] = float(n)
        rung = 3 if not call.use_prompt else {None: 0, 0.2: 1, 0.4: 2}[call.temperature]
        if call.part:
            solved = n == 4 or call.part == "a"
        else:
            solved = rung >= n and n < 4
        if not solved:
            raise recovery.DegenerateError(
                "answer repeats the instruction prompt" if n == 3 else "answer looks like a repetition loop"
            )
        silent = int(call.chunk_idx) % 5 == 0 and not call.part
        return [] if silent else [(call.start, call.end, f"text {call.part}".strip())]

    return model


def _chunks(spark, sf):
    return stage(views.chunk_plan(spark, sf))


@BOOK.add(
    "WITH " + ATTEMPTS + " SELECT job_id, chunk_idx, 'ok' AS outcome, 1 AS segments, 'mock transcript' AS text FROM plan"
)
def udf_2_transcribe(spark, sf):
    chunks = _chunks(spark, sf).withColumn("part", F.lit(""))
    answered = recovery.transcribe(recovery.spread(chunks), recovery.mock_transcriber)
    return answered.select(
        "job_id", "chunk_idx", "outcome", F.size("segments").alias("segments"), F.col("segments")[0]["text"].alias("text")
    )


def _ladder(spark, sf):
    return recovery.run_ladder(
        _chunks(spark, sf), scripted, SETTINGS, splitter=recovery.split_in_middle(0.0), portion=QUICK
    )


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """, n AS (SELECT *, (job_id + chunk_idx) % 6 AS n FROM plan)
SELECT job_id, chunk_idx, CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 7 END::BIGINT AS calls,
  CASE WHEN n = 5 THEN 'failed' WHEN n < 4 AND chunk_idx % 5 = 0 THEN 'no_speech' ELSE 'ok' END AS outcome,
  CASE WHEN n = 5 THEN NULL WHEN n = 4 THEN 2 WHEN chunk_idx % 5 = 0 THEN 0 ELSE 1 END AS segments, CASE WHEN n >= 4 THEN 1 ELSE 0 END::BIGINT AS splits FROM n"""
)
def udf_3_ladder(spark, sf):
    result = _ladder(spark, sf)
    calls = result.attempts.groupBy("job_id", "chunk_idx").agg(
        F.count_if(F.col("action").isNull()).alias("calls"), F.count_if(F.col("action") == "split").alias("splits")
    )
    done = result.done.select("job_id", "chunk_idx", F.size("segments").alias("segments"))
    failed = result.failed.select("job_id", "chunk_idx", F.lit(True).alias("failed"))
    key = ["job_id", "chunk_idx"]
    return (
        calls.join(done.hint("merge"), key, "left")
        .join(failed.hint("merge"), key, "left")
        .select(
            *key,
            "calls",
            F.when(F.col("failed"), "failed").when(F.col("segments") > 0, "ok").otherwise("no_speech").alias("outcome"),
            "segments",
            "splits",
        )
    )


# What each kind of chunk goes through: (n, part, action, stage, temperature, solved).
_RUNGS = [("base", 0.0), ("temperature", 0.2), ("temperature", 0.4)]
_SCRIPT = [
    *[(n, "", None, stage, t, int(i == n)) for n in range(6) for i, (stage, t) in enumerate(_RUNGS) if i <= n],
    (3, "", None, "no_context", 0.0, 1),
    *[(n, "", "split", None, None, 1) for n in (4, 5)],
    *[(n, "a", None, "base", 0.0, 1) for n in (4, 5)],
    (4, "b", None, "base", 0.0, 1),
    *[(5, "b", None, stage, t, 0) for stage, t in _RUNGS],
]


def _script_sql() -> str:
    quoted = lambda x: "NULL" if x is None else repr(x)
    at: dict[int, int] = {}
    rows = []
    for n, *rest in _SCRIPT:
        rows.append(f"({n}, {at.get(n, 0)}, {', '.join(map(quoted, rest))})")
        at[n] = at.get(n, 0) + 1
    return f"script(n, attempt_no, part, action, stage, temperature, solved) AS (VALUES {', '.join(rows)})"


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + ", "
    + _script_sql()
    + """
SELECT job_id, chunk_idx, CAST(attempt_no AS BIGINT) AS attempt_no, part, action, stage, temperature::DOUBLE AS temperature,
  CASE WHEN action IS NULL THEN CASE WHEN part = '' THEN 96 ELSE 48 END END AS audio_millis,
  CASE WHEN solved = 0 THEN 'degenerate' WHEN action IS NULL AND part = '' AND chunk_idx % 5 = 0 THEN 'no_speech' ELSE 'ok' END AS outcome,
  CASE WHEN solved = 0 THEN CASE n WHEN 3 THEN 'answer repeats the instruction prompt' ELSE 'answer looks like a repetition loop' END END AS error,
  CASE WHEN action IS NULL THEN stage = 'no_context' END AS context_omitted, CASE WHEN action IS NULL THEN n::DOUBLE END AS tokens
FROM plan JOIN script ON n = (job_id + chunk_idx) % 6"""
)
def udf_3_attempts(spark, sf):
    """Every try in order, with stage, temperature and error."""
    return _ladder(spark, sf).attempts.select(
        "job_id", "chunk_idx", "attempt_no", "part", "action", "stage", "temperature",
        F.round(F.col("audio_seconds") * 1000).cast("int").alias("audio_millis"), "outcome", "error", "context_omitted",
        F.col("metrics.completion_tokens").alias("tokens"),
    )


def outage():
    """Before the repair: chunk 2 of every third job finds no backend, other jobs have chunks that fail."""

    def model(call: recovery.Call):
        lost, n = call.job_id % 3 == 0, (call.job_id + call.chunk_idx) % 4
        if lost and call.chunk_idx == 2:
            raise recovery.TransientError("backend is away")
        if (n == 1 and call.temperature is None) or (n == 3 and not lost):
            raise recovery.DegenerateError("answer has no content")
        return [(call.start, call.end, "before")]

    return model


def repaired():
    def model(call: recovery.Call):
        if (call.job_id + call.chunk_idx) % 4 == 1 and call.temperature is None:
            raise recovery.DegenerateError("answer has no content")
        return [(call.start, call.end, "after")]

    return model


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """, n AS (SELECT *, (job_id + chunk_idx) % 4 AS n, job_id % 3 = 0 AS lost, max(chunk_idx) OVER (PARTITION BY job_id) >= 2 AS third FROM plan),
c AS (SELECT *, lost AND chunk_idx = 2 AS away, n = 3 AND NOT lost AS failing, CASE WHEN n = 1 THEN 2 ELSE 1 END AS own FROM n)
SELECT job_id, chunk_idx, CAST(CASE WHEN away OR failing THEN 2 ELSE 0 END + own AS BIGINT) AS calls, CAST(own AS BIGINT) AS kept,
  CASE WHEN away OR failing THEN 'after' WHEN lost THEN 'either' ELSE 'before' END AS text,
  CASE WHEN lost AND third THEN 'failed' WHEN bool_or(failing) OVER (PARTITION BY job_id) THEN 'incomplete' ELSE 'completed' END AS first_status,
  'completed' AS second_status FROM c"""
)
def udf_3_resume(spark, sf):
    """Two runs over one log: the second asks only for what the first left without an answer."""
    settings = InferenceSettings(retries=1, fallback_temperatures=(0.2,), split_on_failure=False, parallel_requests=2)
    log = f"{work_folder(spark)}/answers-{uuid.uuid4().hex}"
    key = ["job_id", "chunk_idx"]
    chunks = _chunks(spark, sf)
    first = stage(recovery.run_ladder(chunks, outage, settings, log=log, turn_chunks=16, portion=QUICK).jobs)
    second = recovery.run_ladder(chunks, repaired, settings, log=log, portion=QUICK)
    rows = recovery.AnswerLog(log).read(spark)
    calls = rows.groupBy(*key).agg(F.sum(F.size("history")).alias("calls"))
    kept = second.attempts.groupBy(*key).agg(F.count("*").alias("kept"))
    open_ended = (F.col("job_id") % 3 == 0) & (F.col("chunk_idx") != 2)  # asked in the first run or the second
    text = F.when(open_ended, "either").otherwise(F.col("segments")[0]["text"]).alias("text")
    jobs = first.withColumnRenamed("status", "first_status").join(second.jobs.withColumnRenamed("status", "second_status"), "job_id")
    done = second.done.select(*key, text)
    return calls.join(kept.hint("merge"), key).join(done.hint("merge"), key).join(jobs, "job_id").select(*key, "calls", "kept", "text", "first_status", "second_status")


_ANSWERS = "length(text) > 0 AND doc_id % 9 <> 0"


@BOOK.add(
    f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \n\t]+|[ \n\t]+$', '', 'g') AS text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 50 = 0 OR doc_id % 9 = 0 THEN 'degenerate' WHEN text = '' THEN 'no_speech' ELSE 'ok' END AS outcome,
  CASE WHEN doc_id % 50 = 0 THEN 'answer reached its token limit' WHEN doc_id % 9 = 0 THEN 'answer has no text content' END AS error,
  CASE WHEN doc_id % 50 > 0 AND {_ANSWERS} THEN text END AS text FROM t"""
)
def udf_2_read_answers(spark, sf):
    """Raw answers, as text, as parts, cut at the limit or without text, read inside the call."""
    docs = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.lit(0).cast("long").alias("chunk_idx"), F.lit("").alias("part"),
        F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.coalesce("text", F.lit("")).alias("payload"),
    )
    settings = InferenceSettings(retries=0, compression_ratio_threshold=1e9)
    told = recovery.transcribe(recovery.spread(docs), raw_answers, settings=settings)
    return told.select(F.col("job_id").alias("doc_id"), "outcome", "error", F.get("segments", F.lit(0))["text"].alias("text"))


def raw_answers():
    def model(call: recovery.Call):
        text, half = call.payload, len(call.payload) // 2
        parts = [{"type": "text", "text": text[:half]}, {"type": "image", "text": "pixels"}, {"text": text[half:]}]
        content = 7 if call.job_id % 9 == 0 else parts if call.job_id % 2 else text
        return answers.Answer(content, "length" if call.job_id % 50 == 0 else "stop")

    return model


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + " SELECT job_id, CASE WHEN bool_or((job_id + chunk_idx) % 6 = 5) THEN 'incomplete' ELSE 'completed' END AS status FROM plan GROUP BY job_id"
)
def udf_3_job_status(spark, sf):
    return _ladder(spark, sf).jobs


@BOOK.add(
    "WITH "
    + ATTEMPTS
    + """ SELECT job_id, chunk_idx, CASE WHEN (job_id + chunk_idx) % 6 <> 0 THEN 'degenerate' WHEN chunk_idx % 5 = 0 THEN 'no_speech' ELSE 'ok' END AS outcome,
  CASE WHEN (job_id + chunk_idx) % 6 = 0 AND chunk_idx % 5 <> 0 THEN round(chunk_idx * 0.096::DOUBLE, 6) END AS start_s FROM plan"""
)
def udf_5_order_independent(spark, sf):
    """The same answers as one call after the other, whatever the number of tasks."""
    chunks = _chunks(spark, sf).withColumn("part", F.lit(""))
    answered = recovery.transcribe(recovery.spread(chunks, 16), scripted)
    return answered.select(
        "job_id", "chunk_idx", "outcome", F.round(F.get("segments", F.lit(0))["start"], 6).alias("start_s")
    )


@BOOK.add("SELECT 'good' AS sink, 0 AS failures, count(*) AS rows FROM events UNION ALL SELECT 'broken', 1, 0 FROM (SELECT 1)")
def udf_6_sink_registry(spark, sf):
    path = f"{work_folder(spark)}/sinks-{uuid.uuid4().hex}"
    registry = jobs.SinkRegistry()

    def broken(batch, batch_id):
        raise RuntimeError("this sink never works")

    registry.add("broken", broken)
    registry.add("good", jobs.to_table(path))
    stream = views.stream_of(views.run_event_files(spark, sf), 1)
    jobs.start(stream, registry).awaitTermination()
    counted = spark.read.parquet(f"{path}/batch=*").agg(F.count(F.lit(1)).alias("rows"))
    good = counted.select(F.lit("good").alias("sink"), F.lit(registry.failures["good"]).alias("failures"), "rows")
    batches = {batch for batch, _ in registry.errors["broken"]}
    bad = counted.select(
        F.lit("broken").alias("sink"), F.lit(int(len(batches) == registry.failures["broken"] > 0)).alias("failures"),
        F.lit(0).cast("long").alias("rows"),
    )
    return good.unionByName(bad)


@BOOK.add(
    """WITH c AS (SELECT conv_id, turn, CAST(floor(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS BIGINT) AS n, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id::VARCHAR AS job_id, string_agg(n || ' ' || text || chr(10), '' ORDER BY n) AS numbered,
  string_agg(text || chr(10), '' ORDER BY n) AS plain, conv_id % 7 = 3 AS fails FROM c GROUP BY conv_id)
SELECT job_id, 'num' AS renderer, 'published' AS first_status, sha256(numbered) AS content_sha256 FROM t
UNION ALL SELECT job_id, 'txt', CASE WHEN fails THEN 'failed' ELSE 'published' END, sha256(plain) FROM t"""
)
def udf_6_renderers(spark, sf):
    """One renderer fails for some recordings; after it is mended only those are rendered again."""
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    cues = numbered(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096), "cue_no", first=0)
    cues = stage(cues.select(F.col("conv_id").alias("job_id"), "cue_no", F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "text"))
    path = f"{work_folder(spark)}/files-{uuid.uuid4().hex}"
    first = export.Renderers().add("num", numbered_lines).add("txt", broken_lines).export(cues, path)
    again = export.Renderers().add("num", numbered_lines).add("txt", plain_lines).export(cues, path, only=first.failed)
    status = lambda df, name: df.select("job_id", "renderer", F.lit(name).alias("first_status"))
    told = status(first.published, "published").unionByName(status(first.failed.dropDuplicates(["job_id", "renderer"]), "failed"))
    listed = first.published.unionByName(again.published).select("job_id", "renderer", "path")
    files = spark.read.format("binaryFile").load(f"{path}/*.*").select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("content_sha256"))
    return told.join(listed, ["job_id", "renderer"]).join(files, "path").drop("path")


def numbered_lines(job, part_no, cues):
    return "".join(f"{part_no * export.PART_CUES + i} {text}\n" for i, (_, _, text) in enumerate(cues))


def plain_lines(job, part_no, cues):
    return "".join(text + "\n" for _, _, text in cues)


def broken_lines(job, part_no, cues):
    if int(job) % 7 == 3:
        raise ValueError("cannot render this one")
    return plain_lines(job, part_no, cues)


@BOOK.add(
    """WITH RECURSIVE w AS (SELECT vec_id, unnest(range(0, CAST(ceil(len(embedding) / 24.0) AS BIGINT))) AS i, embedding FROM embeddings),
p AS (SELECT vec_id, i, list_max(list_transform(embedding[i * 24 + 1 : i * 24 + 24], lambda x: abs(x::DOUBLE))) AS peak FROM w),
s AS (SELECT vec_id, i, peak AS v FROM p WHERE i = 0 UNION ALL SELECT p.vec_id, p.i, s.v * 0.5::DOUBLE + p.peak FROM s JOIN p ON p.vec_id = s.vec_id AND p.i = s.i + 1)
SELECT vec_id AS rec_id, i AS frame_idx, round(v, 6) AS prob FROM s"""
)
def udf_1_score_frames(spark, sf):
    vectors = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("s")
    )
    windows = signal.frame_windows(vectors, "s", 24).withColumn("window_idx", F.col("window_idx").cast("long"))
    scored = recovery.score_frames(windows, decaying_peak)
    return scored.select("rec_id", "frame_idx", F.round("prob", 6).alias("prob"))


@BOOK.add(
    """WITH RECURSIVE e AS (SELECT CASE WHEN user_id % 3 > 0 THEN 0 ELSE user_id % 5 END AS rec, ts, event_id, value::DOUBLE AS value FROM events),
p AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY ts, event_id) - 1 AS i, value AS peak FROM e),
s AS (SELECT rec, i, abs(peak) AS v FROM p WHERE i = 0
  UNION ALL SELECT p.rec, p.i, CASE WHEN p.i % 600 < 300 THEN s.v * 0.5::DOUBLE ELSE s.v END + abs(p.peak) FROM s JOIN p ON p.rec = s.rec AND p.i = s.i + 1)
SELECT rec AS rec_id, i AS frame_idx, round(v, 3) AS prob FROM s"""
)
def udf_1_score_in_blocks(spark, sf):
    """One recording has most of the windows; the scorer has stretches in which it forgets nothing."""
    events = views.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 3 > 0, 0).otherwise(F.col("user_id") % 5).cast("long").alias("rec_id"), "ts", "event_id", F.col("value").cast("double").alias("value")
    )
    placed = stage(numbered(events, ["rec_id"], ["ts", "event_id"], F.dayofyear("ts"), "window_idx", first=0))
    windows = placed.select("rec_id", "window_idx", F.array(F.col("window_idx").cast("double"), "value").alias("samples"))
    scored = recovery.score_in_blocks(windows, keeping_peak, lead=64, block=512)
    return scored.select("rec_id", "frame_idx", F.round("prob", 3).alias("prob"))


def keeping_peak():
    """Like ``decaying_peak``, but every other 300 windows nothing of the state decays."""

    def score(samples, state):
        at, peak = samples
        value = abs(peak) if state is None else (state * 0.5 if at % 600 < 300 else state) + abs(peak)
        return value, value

    return score


def decaying_peak():
    """A small recurrent scorer: the peak of the window plus half of the value before."""

    def score(samples, state):
        value = (state or 0.0) * 0.5 + max(abs(x) for x in samples)
        return value, value

    return score


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
