"""Running a user's model over chunks of all recordings, with retries, fallbacks and splits.

The model is a Python function; everything around it is DataFrame work. A chunk climbs its rungs
inside one task: no rung needs another chunk, so the ladder is one pass over the chunks and, for
those it leaves unsolved, one over their parts. Answers go to a log of bounded portions before
anything reads them: a model is never asked twice because a plan was evaluated twice, a lost task
repeats only its own portion, and a later run goes on from what the log holds. Errors travel as rows.

Tables with a row per chunk are merged: their files are a small part of their rows, so Spark would
take them as small enough to be sent through the driver.
"""

from __future__ import annotations

import pickle
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bound_batches, work_folder
from ..session import stage as write
from ..settings import InferenceSettings
from .answers import Answer, DegenerateError, read_answer
from .signal import split_point

CHUNK = ["job_id", "chunk_idx"]
SEGMENTS = "array<struct<start:double,end:double,text:string>>"
METRICS = (
    "struct<completion_tokens:double,finish_reason:string,mean_token_prob:double,logprob_tokens:long,compression_ratio:double>"
)
METRIC_NAMES = ["completion_tokens", "finish_reason", "mean_token_prob", "logprob_tokens", "compression_ratio"]
ENTRY = (
    "part:string,action:string,stage:string,temperature:double,audio_seconds:double,wall_seconds:double,outcome:string,"
    f"error:string,context_omitted:boolean,metrics:{METRICS}"
)
SOLVED = ["ok", "no_speech"]
MIN_SPLIT_SECONDS = 2.0
PORTION = 256  # chunks of one task; a task costs about as much as a fifth of a second of calls
TURN_CHUNKS = 1000  # chunks of one job that are asked before the log is written and read again


class TransientError(Exception):
    """The backend was unavailable; the same call may be repeated."""


@dataclass
class Call:
    """One request to the model, and the place for numbers about it."""

    job_id: object
    chunk_idx: int
    part: str
    start: float
    end: float
    temperature: float | None
    use_prompt: bool
    payload: object = None
    metrics: dict = field(default_factory=dict)


# A model returns segments, or an Answer that is still to be read.
Transcriber = Callable[[Call], "list[tuple[float, float, str]] | Answer"]


def mock_transcriber() -> Transcriber:
    """For tests: one fixed segment over the whole chunk."""
    return lambda call: [(call.start, call.end, "mock transcript")]


def _tries(model: Transcriber, make: Callable[[], Call], settings: InferenceSettings) -> Iterator[tuple[dict, list | None, bool]]:
    """(entry, segments, fatal) of each try of one call: transient errors repeat it unchanged."""
    for attempt in range(settings.retries + 1):
        call = make()
        began = time.monotonic()
        segments, error, fatal = None, None, False
        try:
            given = model(call)
            if isinstance(given, Answer):
                text, _ = read_answer(given, settings, settings.prompt if call.use_prompt else None, call.metrics)
                given = [(call.start, call.end, text)] if text else []
            segments = [{"start": s, "end": e, "text": t} for s, e, t in given]
            outcome = "ok" if segments else "no_speech"
        except TransientError as problem:
            outcome, error, fatal = "transient", str(problem), attempt == settings.retries
        except DegenerateError as problem:
            outcome, error = "degenerate", str(problem)
        except Exception as problem:
            outcome, error, fatal = "error", str(problem), True
        entry = {
            "part": call.part,
            "action": None,
            "audio_seconds": round(call.end - call.start, 3),
            "wall_seconds": time.monotonic() - began,
            "outcome": outcome,
            "error": error,
            "metrics": {m: call.metrics.get(m) for m in METRIC_NAMES},
        }
        yield entry, segments, fatal
        if outcome != "transient":
            return


def transcribe(
    chunks: DataFrame,
    load: Callable[[], Transcriber],
    *,
    stage: str = "base",
    temperature: float | None = None,
    default_temperature: float = 0.0,
    use_prompt: bool = True,
    retries: int = 2,
    settings: InferenceSettings | None = None,
) -> DataFrame:
    """One call per chunk ``(job_id, chunk_idx, part, start, end[, payload])``.

    ``load`` runs once per task and returns the model. Transient errors repeat the same call up
    to ``retries`` times; a row with ``fatal`` set means the job cannot go on. Every try is a row.
    ``settings`` say how an ``Answer`` is read.
    """
    how = settings or InferenceSettings(retries=retries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            rows = []
            for item in pdf.to_dict("records"):
                make = lambda: Call(*[item[c] for c in (*CHUNK, "part", "start", "end")], temperature, use_prompt, item.get("payload"))  # noqa: B023, E731
                for attempt, (entry, segments, fatal) in enumerate(_tries(model, make, how)):
                    del entry["action"]
                    rows.append({**{c: item[c] for c in CHUNK}, **entry, "try_no": attempt, "segments": segments, "fatal": fatal})
            yield pd.DataFrame(rows)

    bound_batches(chunks.sparkSession)
    key = chunks.schema["job_id"].dataType.simpleString()
    answered = chunks.mapInPandas(
        run,
        f"job_id {key}, chunk_idx long, part string, try_no int, audio_seconds double, "
        f"wall_seconds double, outcome string, error string, fatal boolean, segments {SEGMENTS}, metrics {METRICS}",
    )
    used = default_temperature if temperature is None else temperature
    return answered.select(
        "*",
        F.lit(stage).alias("stage"),
        F.lit(used).alias("temperature"),
        F.lit(not use_prompt).alias("context_omitted"),
        F.lit(None).cast("string").alias("action"),
    )


def spread(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distribute calls evenly whatever job they belong to; results carry their own key."""
    by = ("job_id", "chunk_idx", "part")
    # A number of its own, so that adaptive execution does not merge tasks of few bytes and long calls.
    return chunks.repartition(tasks or chunks.sparkSession.sparkContext.defaultParallelism * 4, *by)


# --- splitting ------------------------------------------------------------------------------


def _halves(cut: DataFrame, min_seconds: float) -> DataFrame:
    """Parts ``a`` and ``b`` around ``cut_time``; a chunk that cannot be split has none."""
    inside = (F.col("cut_time") > F.col("start")) & (F.col("cut_time") < F.col("end"))
    part = lambda label, start, end: F.struct(
        F.lit(label).alias("part"), F.col(start).alias("start"), F.col(end).alias("end")
    )
    both = F.explode(F.array(part("a", "start", "cut_time"), part("b", "cut_time", "end")))
    kept = [c for c in cut.columns if c not in ("part", "start", "end", "cut_time")]
    return (
        cut.where(inside & (F.col("end") - F.col("start") >= min_seconds))
        .select(*kept, both.alias("p"))
        .select(*kept, "p.*")
    )


def split_in_middle(min_seconds: float = MIN_SPLIT_SECONDS) -> Callable[[DataFrame], DataFrame]:
    return lambda chunks: _halves(
        chunks.withColumn("cut_time", (F.col("start") + F.col("end")) / 2), min_seconds
    )


def split_at_quietest(samples: DataFrame, rate: int) -> Callable[[DataFrame], DataFrame]:
    """Cut at the quietest point; ``samples(job_id, chunk_idx, pos, value)`` of the chunks."""

    def split(chunks: DataFrame) -> DataFrame:
        wanted = samples.join(chunks.select(*CHUNK), CHUNK, "left_semi")
        cuts = split_point(wanted, CHUNK, rate)
        timed = chunks.join(cuts, CHUNK).withColumn("cut_time", F.col("start") + F.col("cut") / rate)
        return _halves(timed.drop("cut"), MIN_SPLIT_SECONDS)

    return split


# --- the ladder -----------------------------------------------------------------------------


@dataclass
class LadderResult:
    attempts: DataFrame
    done: DataFrame
    failed: DataFrame
    jobs: DataFrame


class _Lost(Exception):
    """A call failed in a way that ends its job."""


def _climb(model: Transcriber, item: dict, piece: dict, settings: InferenceSettings, history: list[dict]) -> list | None:
    """All rungs of one part of a chunk; its segments, or None where every rung failed."""
    rungs = [("base", None, True), *(("temperature", t, True) for t in settings.fallback_temperatures)]
    if settings.context_free_fallback and settings.prompt:
        rungs.append(("no_context", None, False))
    echoed = False
    for stage, temperature, use_prompt in rungs:
        if stage == "no_context" and not echoed:
            continue
        make = lambda: Call(
            item["job_id"], item["chunk_idx"], piece["part"], piece["start"], piece["end"], temperature, use_prompt, piece.get("payload")  # noqa: B023
        )
        for entry, segments, fatal in _tries(model, make, settings):
            used = settings.temperature if temperature is None else temperature
            history.append({**entry, "stage": stage, "temperature": used, "context_omitted": not use_prompt})
            if fatal:
                raise _Lost
            if segments is not None:
                return segments
        limit = entry["metrics"]["finish_reason"] == "length"
        loop = "repetition loop" in (entry["error"] or "")
        echoed |= not limit and not loop and "instruction prompt" in (entry["error"] or "")
    return None


def _pieces(model: Transcriber, item: dict, settings: InferenceSettings) -> dict:
    """One row of the log: the chunk, or its parts one after the other until one fails."""
    history: list[dict] = list(item.get("history") or [])
    segments: list | None = []
    try:
        for piece in item["pieces"]:
            found = _climb(model, item, piece, settings, history)
            if found is None:
                segments = None
                break
            segments += found
        outcome = "unsolved" if segments is None else "done"
    except _Lost:
        segments, outcome = None, "lost"
    return {**{c: item[c] for c in CHUNK}, "outcome": outcome, "segments": segments, "history": history}


def _ask(pieces: DataFrame, load: Callable[[], Transcriber], settings: InferenceSettings) -> DataFrame:
    """Rows of the log for ``pieces(job_id, chunk_idx, pieces[, history])``.

    A task keeps up to ``parallel_requests`` chunks in flight, in the order of their numbers. Once a job is lost the task asks
    nothing more for it; what was in flight is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = load(), set()
        flying: deque = deque()

        def landed() -> dict:
            row = flying.popleft().result()
            if row["outcome"] == "lost":
                broken.add(row["job_id"])
            return row

        with ThreadPoolExecutor(max(1, settings.parallel_requests)) as pool:
            for pdf in batches:
                rows = []
                for item in pdf.to_dict("records"):
                    while len(flying) >= max(1, settings.parallel_requests):
                        rows.append(landed())
                    if item["job_id"] not in broken:
                        flying.append(pool.submit(_pieces, model, item, settings))
                while flying:
                    rows.append(landed())
                if rows:
                    yield pd.DataFrame(rows)

    bound_batches(pieces.sparkSession)
    key = pieces.schema["job_id"].dataType.simpleString()
    return pieces.mapInPandas(
        run, f"job_id {key}, chunk_idx long, outcome string, segments {SEGMENTS}, history array<struct<{ENTRY}>>"
    )


class AnswerLog:
    """Answers as a folder of written portions; what one run wrote, the next goes on from.

    A row is a chunk as one step of one run left it: ``done``, ``unsolved`` or ``lost``. Portions
    are only added. Rows of a step count as soon as they are there: each is whole in itself.
    """

    def __init__(self, path: str, key: str = "long") -> None:
        self.path = path
        self.schema = (
            f"job_id {key}, chunk_idx long, outcome string, segments {SEGMENTS}, history array<struct<{ENTRY}>>, run int, turn long, step int"
        )

    def read(self, spark: SparkSession) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path)

    def next_run(self, spark: SparkSession) -> int:
        last = self.read(spark).agg(F.max("run")).first()[0]
        return 0 if last is None else last + 1

    def append(self, rows: DataFrame, run: int, turn: int, step: int) -> DataFrame:
        path = f"{self.path}/run={run}/turn={turn}/step={step}"
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def latest(self, spark: SparkSession) -> DataFrame:
        """(job_id, chunk_idx, run, outcome, segments, history): each chunk as its last run left it."""
        row = F.struct("run", "step", "outcome", "segments", "history")
        # A chunk has two rows a run at most.
        kept = self.read(spark).groupBy(*CHUNK).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        last = F.element_at("rows", -1)
        own = F.filter("rows", lambda r: r["run"] == last["run"])
        return kept.select(
            *CHUNK,
            last["run"].alias("run"),
            last["outcome"].alias("outcome"),
            last["segments"].alias("segments"),
            F.flatten(F.transform(own, lambda r: r["history"])).alias("history"),
        )


def run_ladder(
    chunks: DataFrame,
    load: Callable[[], Transcriber],
    settings: InferenceSettings,
    *,
    splitter: Callable[[DataFrame], DataFrame] | None = None,
    tasks: int | None = None,
    done: DataFrame | None = None,
    attempts: DataFrame | None = None,
    log: str | None = None,
    portion: int = PORTION,
    turn_chunks: int = TURN_CHUNKS,
) -> LadderResult:
    """Transcribe ``chunks(job_id, chunk_idx, start, end[, payload])`` of many jobs.

    Base call, each fallback temperature, one call without context where the prompt was echoed,
    then one split whose parts climb the same rungs in order. Chunks that stay unsolved are
    failed and leave their job incomplete. An unavailable backend or any other error loses the job:
    its tasks ask nothing more for it, later turns leave it out, and what was finished stays.

    Chunks in ``done(job_id, chunk_idx, segments)``, with their ``attempts``, and those that the
    folder ``log`` has answers of are not asked again; all others get a fresh attempt. Every turn
    takes the next ``turn_chunks`` numbers of every job, in tasks of about ``portion`` chunks
    (or ``tasks`` tasks), and is written to the log before the next begins.
    """
    spark = chunks.sparkSession
    key = chunks.schema["job_id"].dataType.simpleString()
    answers = AnswerLog(log or f"{work_folder(spark)}/answers-{uuid.uuid4().hex}", key)
    run = answers.next_run(spark)
    known = answers.read(spark).where("outcome = 'done'").select(*CHUNK)
    if done is not None:
        known = known.unionByName(done.select(*CHUNK))
    turn = F.floor(F.col("chunk_idx") / turn_chunks).cast("long").alias("turn")
    planned = write(chunks.select(*CHUNK, "start", "end", turn))
    asked = planned.join(known.distinct().hint("merge"), CHUNK, "left_anti") if done is not None or run else planned
    sizes = {r["turn"]: r["n"] for r in asked.groupBy("turn").agg(F.count("*").alias("n")).collect()}
    whole = F.struct(F.lit("").alias("part"), "start", "end", *[c for c in ("payload",) if c in chunks.columns])
    for number in sorted(sizes):  # one row per turn, and a turn is a bounded number of chunks of each job
        lost = answers.read(spark).where((F.col("run") == run) & (F.col("outcome") == "lost")).select("job_id").distinct()
        open_keys = asked.where(F.col("turn") == number).select(*CHUNK)
        todo = chunks if len(sizes) == 1 else chunks.where(turn == number)
        if done is not None or run:
            todo = todo.join(open_keys.hint("merge"), CHUNK, "left_semi")
        if number != min(sizes):
            todo = todo.join(lost, "job_id", "left_anti")
        n = tasks or max(-(-sizes[number] // portion), min(sizes[number], spark.sparkContext.defaultParallelism))
        pieces = todo.select(*CHUNK, F.array(whole).alias("pieces")).repartition(n, *CHUNK).sortWithinPartitions(*CHUNK)
        answered = answers.append(_ask(pieces, load, settings), run, number, 0)
        if settings.split_on_failure and splitter is not None:
            _split(todo, answered, load, settings, splitter, n, answers, run, number)
    return _resolve(planned, answers, run, done, attempts)


def _split(todo, answered, load, settings, splitter, n, answers, run, number) -> None:
    """The step for chunks that no rung solved: two parts each, asked one after the other."""
    unsolved = answered.where("outcome = 'unsolved'").select(*CHUNK)
    if unsolved.isEmpty():
        return
    pending = write(todo.join(unsolved.hint("merge"), CHUNK, "left_semi").withColumn("part", F.lit("")))
    piece = F.struct("part", "start", "end", *[c for c in ("payload",) if c in todo.columns])
    parts = splitter(pending).groupBy(*CHUNK).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    metrics = F.lit(None).cast(METRICS)
    entry = lambda outcome, error: F.array(
        F.struct(
            F.lit("").alias("part"), F.lit("split").alias("action"), F.lit(None).cast("string").alias("stage"),
            F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("double").alias("audio_seconds"),
            F.lit(None).cast("double").alias("wall_seconds"), F.lit(outcome).alias("outcome"),
            F.lit(error).cast("string").alias("error"), F.lit(None).cast("boolean").alias("context_omitted"), metrics.alias("metrics"),
        )
    )
    parts = write(parts)
    split = parts.withColumn("history", entry("ok", None)).repartition(n, *CHUNK).sortWithinPartitions(*CHUNK)
    whole = pending.select(*CHUNK).join(parts.select(*CHUNK).hint("merge"), CHUNK, "left_anti")
    unsplit = whole.select(
        *CHUNK, F.lit("unsolved").alias("outcome"), F.lit(None).cast(SEGMENTS).alias("segments"),
        entry("error", "chunk cannot be split").alias("history"),
    )
    answers.append(_ask(split, load, settings).unionByName(unsplit), run, number, 1)


def _resolve(planned: DataFrame, answers: AnswerLog, run: int, done: DataFrame | None, attempts: DataFrame | None) -> LadderResult:
    spark = planned.sparkSession
    # The log may know chunks that are not asked for any more.
    latest = write(answers.latest(spark).join(planned.select(*CHUNK).hint("merge"), CHUNK, "left_semi"))
    entries = latest.select(*CHUNK, F.posexplode("history").alias("attempt_no", "e"))
    columns = [c.split(":")[0] for c in ENTRY.split("metrics:")[0].rstrip(",").split(",")] + ["metrics"]
    made = entries.select(*CHUNK, F.col("attempt_no").cast("long").alias("attempt_no"), *[F.col(f"e.{c}").alias(c) for c in columns])
    solved = latest.where("outcome = 'done'").select(*CHUNK, "segments")
    if done is not None:
        earlier = done.join(latest.select(*CHUNK).hint("merge"), CHUNK, "left_anti").select(*CHUNK, "segments")
        solved = solved.unionByName(earlier)
        if attempts is not None:
            made = made.unionByName(attempts.join(earlier.select(*CHUNK).hint("merge"), CHUNK, "left_semi").select(*made.columns))
    errors = F.filter(F.transform("history", lambda e: e["error"]), lambda e: e.isNotNull())
    unsolved = latest.where("outcome = 'unsolved'").select(*CHUNK, F.get(errors, F.size(errors) - 1).alias("error"))
    failed = planned.join(unsolved.hint("merge"), CHUNK).select(
        *CHUNK, "start", "end", F.coalesce("error", F.lit("no usable transcription")).alias("error")
    )
    lost = latest.where((F.col("run") == run) & (F.col("outcome") == "lost")).select("job_id").distinct().withColumn("lost", F.lit(True))
    counts = failed.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    jobs = (
        planned.select("job_id")
        .distinct()
        .join(lost.hint("merge"), "job_id", "left")
        .join(counts.hint("merge"), "job_id", "left")
        .select(
            "job_id",
            F.when(F.col("lost"), "failed").when(F.col("n") > 0, "incomplete").otherwise("completed").alias("status"),
        )
    )
    return LadderResult(made, solved, failed, jobs)


# --- frame scorers --------------------------------------------------------------------------

Scorer = Callable[[object, object], tuple[float, object]]


def score_frames(
    windows: DataFrame,
    load: Callable[[], Scorer],
    *,
    warm_up: int | None = None,
    block: int = 1 << 16,
) -> DataFrame:
    """Probabilities from a model that carries a state from window to window.

    ``windows(rec_id, window_idx, samples)``; the scorer maps ``(samples, state)`` to
    ``(probability, state)``, with ``None`` as the first state. Where the state depends on no
    more than the last ``warm_up`` windows, a long recording is scored in blocks that start with
    that many windows of the block before. Otherwise windows have to be seen in order, and a
    recording streams through one task batch by batch without being held in memory.
    """
    key = windows.schema["rec_id"].dataType.simpleString()
    own = F.lit(0).cast("long") if warm_up is None else F.floor(F.col("window_idx") / block).cast("long")
    placed = windows.withColumn("own", own)
    if warm_up is None:
        placed = placed.withColumn("block", F.col("own"))
    else:
        near_end = F.col("window_idx") % block >= block - warm_up
        placed = placed.withColumn(
            "block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
        )
    ordered = placed.repartition("rec_id", "block").sortWithinPartitions("rec_id", "block", "window_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        here, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.rec_id, row.block) != here:
                    here, state = (row.rec_id, row.block), None
                prob, state = model(row.samples, state)
                if row.own == row.block:
                    out.append((row.rec_id, row.window_idx, prob))
            yield pd.DataFrame(out, columns=["rec_id", "frame_idx", "prob"])

    return ordered.select("rec_id", "window_idx", "samples", "own", "block").mapInPandas(
        run, f"rec_id {key}, frame_idx long, prob double"
    )


def _blocks(windows: DataFrame, block: int, lead: int) -> DataFrame:
    """Windows with the block they are in (``own``) and the blocks they are read for."""
    own = F.floor(F.col("window_idx") / block).cast("long")
    near_end = F.col("window_idx") % block >= block - lead
    read_for = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return windows.select("rec_id", "window_idx", "samples", own.alias("own"), F.explode(read_for).alias("block"))


def score_in_blocks(
    windows: DataFrame, load: Callable[[], Scorer], *, lead: int = 256, block: int = 1 << 14
) -> DataFrame:
    """What ``score_frames`` gives in one pass per recording, with many tasks per recording.

    Every block of ``block`` windows is scored at once, from a state guessed by the ``lead`` windows
    before it. Where the guess is not the state that the block before ends in, the block is scored
    again from that state beside the guess, until both are in the same state: from there on the
    first scores hold. Blocks whose end changed have the next one checked again, so the result is
    exact for any scorer that goes by (samples, state) alone. One whose state forgets its past needs
    one or two rounds; one that never does needs as many as there are blocks. States are compared
    as pickled.
    """
    key = windows.schema["rec_id"].dataType.simpleString()
    rows = f"rec_id {key}, block long, frame_idx long, prob double, start binary, end binary"
    columns = ["rec_id", "block", "frame_idx", "prob", "start", "end"]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, here, state, start = load(), None, None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.rec_id, row.block) != here:
                    if here and start is not None:
                        out.append((*here, None, None, start, pickle.dumps(state)))
                    here, state, start = (row.rec_id, row.block), None, None
                if row.own == row.block and start is None:
                    start = pickle.dumps(state)
                prob, state = model(row.samples, state)
                if row.own == row.block:
                    out.append((*here, row.window_idx, prob, None, None))
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if here and start is not None:
            yield pd.DataFrame([(*here, None, None, start, pickle.dumps(state))], columns=columns, dtype=object)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, here, true, guess, met, begin, end = load(), None, None, None, False, None, None
        finished = lambda: (*here, None, None, begin, end if met else pickle.dumps(true))
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.rec_id, row.block) != here:
                    if here:
                        out.append(finished())
                    here, begin, end, met = (row.rec_id, row.block), bytes(row.begin), bytes(row.end), False
                    true, guess = pickle.loads(begin), pickle.loads(bytes(row.start))
                if not met:
                    prob, true = model(row.samples, true)
                    _, guess = model(row.samples, guess)
                    out.append((*here, row.window_idx, prob, None, None))
                    met = pickle.dumps(true) == pickle.dumps(guess)
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if here:
            yield pd.DataFrame([finished()], columns=columns, dtype=object)

    tasks = windows.sparkSession.sparkContext.defaultParallelism * 4
    order = ("rec_id", "block", "window_idx")
    placed = _blocks(windows, block, lead).repartition(tasks, "rec_id", "block").sortWithinPartitions(*order)
    written = [write(placed.mapInPandas(first, rows))]
    ends = written[0].where("end is not null").select("rec_id", "block", "start", "end")
    before = Window.partitionBy("rec_id").orderBy("block")  # one row per block
    while True:
        known = ends.withColumn("begin", F.lag("end").over(before))
        wrong = write(known.where(F.col("begin").isNotNull() & (F.col("begin") != F.col("start"))))
        if wrong.isEmpty():
            break
        todo = _blocks(windows, block, 0).drop("own").join(wrong, ["rec_id", "block"])
        todo = todo.repartition(tasks, "rec_id", "block").sortWithinPartitions(*order)
        written.append(write(todo.mapInPandas(again, rows)))
        mended = written[-1].where("end is not null").select("rec_id", "block", "start", "end")
        ends = write(ends.join(mended, ["rec_id", "block"], "left_anti").unionByName(mended))
    scores = written[0].where("frame_idx is not null").select("rec_id", "frame_idx", "prob")
    for i, later in enumerate(written[1:]):
        newer = later.where("frame_idx is not null").select("rec_id", "frame_idx", F.col("prob").alias(f"prob_{i}"))
        scores = scores.join(newer, ["rec_id", "frame_idx"], "left").select(
            "rec_id", "frame_idx", F.coalesce(f"prob_{i}", "prob").alias("prob")
        )
    return scores
