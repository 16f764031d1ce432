"""Domain-shaped views over the given tables (events, documents, orders, …).

Each view only renames and re-shapes columns, over all rows. Positions are numbered per key in
day blocks, so that one busy key does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import numbered, running
from ..session import write_table

FRAME_SECONDS = 0.032
THRESHOLD = 0.5
EVENT_TYPES = [  # Fixed values: the event types, in protocol order.
    "run.started",
    "job.started",
    "stage.started",
    "stage.finished",
    "stage.progress",
    "job.reused",
    "job.prepared",
    "chunk.started",
    "chunk.attempt",
    "chunk.finished",
    "progress",
    "resource.sample",
    "log",
    "warning",
    "job.finished",
    "run.finished",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables hold UTC times without a zone; casts and formats follow the session.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def _k():
    return F.get_json_object("props", "$.k").cast("int")


_WRITTEN: dict[tuple[str, str, str], tuple[tuple, str, StructType]] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table; empty where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return ()
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(where))


def _written(spark: SparkSession, sf_dir: str, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table many queries share, written once for each state of its source table.

    It is written anew when files of the source have changed or what was written is gone.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    state = _files(spark, f"{sf_dir}/{source}.parquet")
    known = _WRITTEN.get(key)
    if known is None or known[0] != state or not _files(spark, known[1]):
        table = build()
        known = _WRITTEN[key] = (state, write_table(table), table.schema)
    return spark.read.schema(known[2]).parquet(known[1])


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(
        spark,
        sf_dir,
        "numbered_events",
        "events",
        lambda: numbered(
            table(spark, sf_dir, "events"),
            ["user_id"],
            ["ts", "event_id"],
            F.to_date("ts"),
            "frame_idx",
        ).withColumn("k", _k()),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("rec_id"), "frame_idx", (F.col("k") / 100.0).alias("prob")
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("rec_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "rec_id",
            F.lit(FRAME_SECONDS).alias("frame_seconds"),
            F.lit(THRESHOLD).alias("threshold"),
            (F.col("n") * FRAME_SECONDS).alias("total_seconds"),
            "n",
        )
    )


def attempts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_events(spark, sf_dir).withColumn(
        "value_cents", F.rint(F.col("value") * 100).cast("long")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("job_id"),
        F.floor(F.col("frame_idx") / 3).cast("long").alias("chunk_idx"),
        (F.col("frame_idx") % 3).alias("attempt_no"),
        F.lit("").alias("part"),
        F.lit(None).cast("string").alias("action"),
        F.when(F.col("frame_idx") % 3 == 0, "base").otherwise("temperature").alias("stage"),
        F.when(F.col("frame_idx") % 3 == 0, 0.0).otherwise((F.col("frame_idx") % 3) * 0.2).alias("temperature"),
        F.lit(FRAME_SECONDS * 3).alias("audio_seconds"),
        (F.rint(F.col("value") * 100) / 100).alias("wall_seconds"),
        F.when(kind.isin("view", "click", "purchase"), "ok")
        .when(kind == "signup", "no_speech")
        .otherwise("degenerate")
        .alias("outcome"),
        F.when(
            kind == "error",
            F.when(F.col("k") % 3 == 0, "chunk looks like a repetition loop")
            .when(F.col("k") % 3 == 1, "chunk repeats the instruction prompt")
            .otherwise("chunk returned no content"),
        ).alias("error"),
        F.struct(
            F.col("k").cast("double").alias("completion_tokens"),
            F.when((kind == "error") & (F.col("k") % 5 == 0), "length").otherwise("stop").alias("finish_reason"),
            (F.col("k") / 100.0).alias("mean_token_prob"),
            F.col("k").cast("long").alias("logprob_tokens"),
        ).alias("metrics"),
    )


def last_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    return (
        a.groupBy("job_id", "chunk_idx")
        .agg(F.max_by(F.struct("outcome", "error"), "attempt_no").alias("last"))
        .select("job_id", "chunk_idx", "last.outcome", "last.error")
    )


_SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = FRAME_SECONDS * 3
    start = F.col("chunk_idx") * length
    return last_attempts(spark, sf_dir).where(F.col("outcome") != "degenerate").select(
        "job_id",
        "chunk_idx",
        F.when(
            F.col("outcome") == "ok",
            F.array(F.struct(start.alias("start"), (start + length).alias("end"), F.lit("speech").alias("text"))),
        )
        .otherwise(F.array())
        .cast(_SEGMENTS)
        .alias("segments"),
    )


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = FRAME_SECONDS * 3
    start = F.col("chunk_idx") * length
    return last_attempts(spark, sf_dir).where(F.col("outcome") == "degenerate").select(
        "job_id", "chunk_idx", start.alias("start"), (start + length).alias("end"), "error"
    )


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned chunk per three frames, including chunks nobody attempted beyond the last."""
    length = FRAME_SECONDS * 3
    start = F.col("chunk_idx") * length
    return (
        recordings(spark, sf_dir)
        .select(
            F.col("rec_id").alias("job_id"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 3).cast("long"))).alias("chunk_idx"),
        )
        .select("job_id", "chunk_idx", start.alias("start"), (start + length).alias("end"))
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn(
        "length", F.greatest(F.lit(1.0), F.length("text") / 15.0)
    )
    summed = running(
        turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096).cast("long"),
        {"before": ("sum", F.col("length"))}, exclusive=True,
    )
    start = F.coalesce("before", F.lit(0.0))
    return summed.select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").alias("seg_idx"),
        start.alias("start"),
        (start + F.col("length")).alias("end"),
        "text",
        F.col("role").alias("speaker"),
        F.lit("chunk").alias("timing_source"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 == 0, F.to_json(F.struct(text.alias("transcript"))))
        .when(F.col("doc_id") % 11 == 0, F.concat(F.lit("language "), F.col("lang"), F.lit("<asr_text>"), text))
        .otherwise(text)
        .alias("content"),
        F.when(F.col("doc_id") % 50 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.when(F.col("doc_id") % 7 == 0, "json")
        .when(F.col("doc_id") % 11 == 0, "tagged")
        .otherwise("plain")
        .alias("mode"),
        "lang",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("name"),
        F.encode("text", "UTF-8").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        "source",
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    kind = F.col("page_id") % 5
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(
            F.when(kind == 4, F.concat(F.lit(".hidden/"), path)).otherwise(path),
            F.when(kind == 0, ".wav").when(kind == 1, ".MP3").when(kind == 2, ".txt").when(kind == 3, ".mkv").otherwise(".wav"),
        ).alias("path"),
        F.octet_length("html").cast("long").alias("length"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source"),
        F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "processing")
        .otherwise("incomplete")
        .alias("status"),
        F.col("o_orderdate").alias("created"),
        F.col("o_orderdate").alias("updated"),
        F.col("o_orderpriority").alias("model"),
        (F.col("o_totalprice") / 1e6).alias("rtf"),
        F.col("o_totalprice").alias("duration"),
    )


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a version (order) with a stage map; a stage that was not measured is null."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("version"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("started"),
        F.create_map(
            F.lit("preparation"), F.col("l_quantity"),
            F.lit("inference"), F.col("l_extendedprice"),
            F.lit("export"), F.when(F.col("l_linestatus") != "O", F.col("l_discount")),
        ).alias("stages_seconds"),
        F.col("l_extendedprice").alias("wall_seconds"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("rec_id"), F.posexplode("embedding").alias("pos", "x"))
        .select(
            "rec_id",
            F.col("pos").cast("long").alias("pos"),
            F.least(F.greatest(F.rint(F.col("x").cast("double") * 32767), F.lit(-32768.0)), F.lit(32767.0))
            .cast("int")
            .alias("value"),
        )
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day, events numbered in time order within it, types cycling by ``k``."""
    ordered = _written(
        spark,
        sf_dir,
        "numbered_runs",
        "events",
        lambda: numbered(
            table(spark, sf_dir, "events").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd")),
            ["run_id"],
            ["ts", "event_id"],
            F.hour("ts"),
            "seq",
            first=1,
        ),
    )
    return ordered.select(
        F.lit(1).alias("schema_version"),
        "run_id",
        "seq",
        "ts",
        ((F.unix_micros("ts") % 86_400_000_000) / 1e6).alias("elapsed_s"),
        F.col("user_id").alias("job_id"),
        F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), _k() % 16 + 1).alias("type"),
        _k().alias("k"),
        F.col("value"),
        "event_id",
        "event_type",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.floor(F.col("k") / 25).cast("long")
    return _numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("path"),
        (F.col("frame_idx") + 1).alias("scan"),
        size.alias("size"),
        size.alias("mtime"),
        "event_type",
    )


def run_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_events`` with their payload as JSON, as an event log carries it."""
    k = F.col("k")
    data = F.to_json(
        F.struct(
            F.lit("transcribe").alias("command"),
            F.concat(F.lit("model-"), k.cast("string")).alias("model"),
            F.element_at(F.array(*[F.lit(x) for x in ("probe", "preparation", "inference", "export")]), k % 4 + 1).alias("stage"),
            F.col("value").alias("seconds"),
            F.when(k % 3 == 0, "failed").otherwise("completed").alias("status"),
            F.when(k % 2 == 0, "info").otherwise("error").alias("level"),
            F.col("event_type").alias("message"),
            F.element_at(F.array(*[F.lit(x) for x in ("ok", "no_speech", "failed")]), k % 3 + 1).alias("outcome"),
            (k % 10).alias("index"),
            (k % 7 + 6).alias("planned"),
            (k % 2).alias("exit_status"),
            F.col("value").alias("cpu_percent"),
        )
    )
    return run_events(spark, sf_dir).select(
        "schema_version", "seq", "ts", "elapsed_s", "run_id", F.col("job_id").cast("string").alias("job_id"), "type", data.alias("data")
    )


def run_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a written table; its files serve as the input of streams."""
    return _written(spark, sf_dir, "event_log", "events", lambda: run_event_log(spark, sf_dir))


def stream_of(table: DataFrame, files_per_trigger: int = 2) -> DataFrame:
    """A stream over the files of a written table."""
    spark = table.sparkSession
    plan = table._jdf.queryExecution().optimizedPlan().collectLeaves().head()
    folder = plan.relation().location().rootPaths().head().toString()  # the folder, not its files
    return (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )
