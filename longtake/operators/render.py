"""Transcripts, subtitles, reports and logs as text.

A file is a sequence of bounded parts: the parts of one file, joined in order without anything
between them, are its content. So a transcript of any length never has to fit one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clock, duration_text, one_decimal, timing_text
from .ordered import numbered

PART_CUES = 1000
# Formats in their canonical order with their file names.
FILES = {
    "txt": "transcript.txt",
    "md": "transcript.md",
    "srt": "transcript.srt",
    "vtt": "transcript.vtt",
    "json": "transcript.json",
    "report-md": "run-report.md",
    "report-json": "report.json",
    "mp3": "audio.mp3",
    "flac": "audio.flac",
    "mp4": "video.mp4",
}
COARSE = "Cue times are the borders of audio chunks; they are not aligned to words."
SYNTHETIC = "Made by the mock transcriber: nothing was recognised."
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def parse_formats(value: str | Sequence[str]) -> list[str]:
    """The selected formats once each, in canonical order; nothing or unknown ones are refused."""
    parts = [p.strip() for p in value.split(",")] if isinstance(value, str) else list(value)
    if not parts or any(p not in FILES for p in parts):
        raise ValueError(f"select at least one of {', '.join(FILES)}")
    return [f for f in FILES if f in parts]


def warnings_for(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct warnings of each transcript in order: its own, then the derived ones."""
    coarse = segments.groupBy("job_id").agg(F.bool_or(F.col("timing_source") == "chunk").alias("coarse"))
    derived = F.array_compact(
        F.array(
            F.when(F.coalesce("coarse", F.lit(False)), COARSE),
            F.when(F.col("backend") == "mock", SYNTHETIC),
        )
    )
    return (
        transcripts.join(coarse, "job_id", "left")
        .withColumn("warnings", F.array_distinct(F.concat("warnings", derived)))
        .drop("coarse")
    )


def cue_text(text: Column, speaker: Column) -> Column:
    """Lines trimmed, blank ones dropped, the speaker in front."""
    trim = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(text, LINE_END), trim), lambda t: t != "")
    body = F.array_join(lines, "\n")
    name = F.trim(F.regexp_replace(speaker, r"(?U)\s+", " "))
    return F.when(F.length(speaker) > 0, F.concat(F.lit("["), name, F.lit("] "), body)).otherwise(body)


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _cue(number: Column, separator: str, text: Column) -> Column:
    times = F.concat(clock(F.col("start"), separator), F.lit(" --> "), clock(F.col("end"), separator))
    return F.concat(number.cast("string"), F.lit("\n"), times, F.lit("\n"), text, F.lit("\n\n"))


def _rows(kinds: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("format"), v.alias("block")) for k, v in kinds.items()]))


def render(transcripts: DataFrame, segments: DataFrame, formats: Sequence[str]) -> DataFrame:
    """``(job_id, format, filename, part_no, content)`` for the selected text formats.

    ``transcripts(job_id, backend, model, duration, warnings)``, ``segments(job_id, seg_idx,
    start, end, text, speaker, timing_source)``.
    """
    formats = parse_formats(formats)
    warned = warnings_for(transcripts, segments)
    nl = lambda *parts: F.concat(*[x for p in parts for x in ((F.lit(p) if isinstance(p, str) else p), F.lit("\n"))])
    status = F.when(F.col("backend") == "mock", "mock_completed").otherwise("completed")
    heads = {
        "txt": F.lit(""),
        "srt": F.lit(""),
        "vtt": F.lit("WEBVTT\n\n"),
        "md": F.concat(
            nl("# Transcript", "", F.concat(F.lit("Backend: "), "backend"), F.concat(F.lit("Model: "), "model"), ""),
            F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("> "), w, F.lit("\n"))), ""),
        ),
        "json": F.concat(
            F.regexp_replace(F.to_json(F.struct("job_id", "backend", "model", "duration", "warnings")), r"\}$", ""),
            F.lit(',"segments":['),
        ),
    }
    cue_no = F.col("cue_no")
    cue = cue_text(F.col("text"), F.col("speaker"))
    blocks = {
        "txt": F.concat(F.col("text"), F.lit("\n")),
        "srt": _cue(cue_no, ",", cue),
        "vtt": _cue(cue_no, ".", _escaped(cue)),
        "md": F.concat(
            F.lit("\n## "), clock(F.col("start"), "."), F.lit(" – "), clock(F.col("end"), "."),
            F.lit("\n\n"), F.col("text"), F.lit("\n"),
        ),
        "json": F.concat(
            F.when(cue_no > 1, ",\n").otherwise("\n"),
            F.to_json(F.struct("start", "end", "text", "speaker", "timing_source")),
        ),
    }
    chosen = [f for f in formats if f in heads]
    head_rows = warned.select(
        "job_id", F.lit(0).cast("long").alias("cue_no"), _rows({f: heads[f] for f in chosen}).alias("r")
    )
    counted = numbered(
        segments, ["job_id"], ["seg_idx"], F.floor(F.col("seg_idx") / 65536), "cue_no", first=1
    )
    cue_rows = counted.select("job_id", "cue_no", _rows({f: blocks[f] for f in chosen}).alias("r"))
    everything = head_rows.unionByName(cue_rows).select("job_id", "cue_no", "r.format", "r.block")
    if "json" in chosen:
        tail = counted.groupBy("job_id").agg(F.max("cue_no").alias("last"))
        tails = transcripts.select("job_id").join(tail, "job_id", "left").select(
            "job_id",
            (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("cue_no"),
            F.lit("json").alias("format"),
            F.lit("\n]}\n").alias("block"),
        )
        everything = everything.unionByName(tails)
    if "report-json" in formats:
        n = counted.groupBy("job_id").agg(F.count(F.lit(1)).alias("segment_count"))
        reports = warned.join(n, "job_id", "left").select(
            "job_id",
            F.lit(0).cast("long").alias("cue_no"),
            F.lit("report-json").alias("format"),
            F.concat(
                F.to_json(
                    F.struct(
                        "job_id",
                        status.alias("status"),
                        "backend",
                        "model",
                        F.col("duration").alias("duration_seconds"),
                        F.coalesce("segment_count", F.lit(0).cast("long")).alias("segment_count"),
                        "warnings",
                    )
                ),
                F.lit("\n"),
            ).alias("block"),
        )
        everything = everything.unionByName(reports)
    part = F.floor(F.greatest(F.col("cue_no") - 1, F.lit(0)) / PART_CUES).cast("long")
    listed = F.sort_array(F.collect_list(F.struct("cue_no", "block")))
    names = F.create_map(*[F.lit(x) for pair in FILES.items() for x in pair])
    return (
        everything.groupBy("job_id", "format", part.alias("part_no"))
        .agg(F.array_join(F.transform(listed, lambda x: x["block"]), "").alias("content"))
        .select("job_id", "format", names[F.col("format")].alias("filename"), "part_no", "content")
    )


def publish(rendered: DataFrame, formats: str | Sequence[str]) -> DataFrame:
    """Only the selected formats."""
    return rendered.where(F.col("format").isin(parse_formats(formats)))


def write_transcripts(rendered: DataFrame, formats: str | Sequence[str], path: str) -> None:
    """One folder per format, clustered and sorted by job and part.

    A file of one job is the range of its rows; a filter on ``job_id`` skips all others, and
    many small jobs share files.
    """
    by = ("job_id", "part_no")
    chosen = publish(rendered, formats).repartitionByRange(*by).sortWithinPartitions("format", *by)
    chosen.write.mode("overwrite").partitionBy("format").parquet(path)


def transcript_order(segments: DataFrame) -> DataFrame:
    """Segments numbered by time within their job."""
    return numbered(
        segments, ["job_id"], ["start", "end"], F.floor(F.col("start") / 86400), "position"
    )


# Stages in report order with the label of their row.
TIMING_ROWS = [
    ("preparation", "Preparing, all steps"),
    ("probe", "> reading headers"),
    ("audio_extraction", "> extracting audio"),
    ("speech_detection", "> finding speech"),
    ("chunk_slicing", "> cutting chunks"),
    ("inference", "Transcribing"),
    ("export", "Writing files"),
    ("archive", "Archiving"),
    ("catalog", "Updating the catalog"),
]
STEPS = ["audio_extraction", "speech_detection", "chunk_slicing"]


def speed_text(rtf: Column) -> Column:
    speed = 1 / rtf

    return F.when(
        rtf > 0,
        F.concat(
            F.lit("- Real-time factor "),
            F.bround(rtf, 4).cast("string"),
            F.lit(", that is "),
            one_decimal(F.when(speed >= 1, speed).otherwise(rtf)),
            F.when(speed >= 1, "x faster").otherwise("x slower"),
            F.lit(" than the recording plays"),
        ),
    )


def run_report(versions: DataFrame) -> DataFrame:
    """Report lines ``(job_id, line_no, line)`` in their fixed order.

    ``versions(job_id, name, version, model, status, completion_percent, total_wall,
    stages_seconds map, analysed_seconds, real_time_factor, total_chunks, chunks_ok,
    chunks_no_speech, chunks_failed, error)``. The number of lines per version is fixed.
    """
    stage = lambda k: F.col("stages_seconds")[k]
    split = None
    for step in STEPS:
        split = stage(step).isNotNull() if split is None else split | stage(step).isNotNull()
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("timed"), F.lit(None).cast("double").alias("seconds"))
    timed = lambda head, seconds: F.struct(F.lit(head).alias("text"), F.lit(True).alias("timed"), seconds.cast("double").alias("seconds"))
    percent = F.when(
        F.col("completion_percent").isNotNull(),
        F.concat(
            F.regexp_replace(F.bround("completion_percent", 1).cast("string"), r"\.0$", ""), F.lit("%")
        ),
    ).otherwise("unknown")
    text = lambda label, column, default="unknown": F.concat(
        F.lit(f"- {label}: "), F.coalesce(F.col(column).cast("string"), F.lit(default))
    )
    lines: list[Column] = [
        F.lit("# Run report"),
        F.lit(""),
        text("Recording", "name"),
        text("Version", "version"),
        text("Model", "model"),
        text("Status", "status"),
        F.concat(F.lit("- Completion: "), percent),
        F.lit(""),
        F.lit("## Timings"),
        F.lit(""),
        F.lit("| Stage | Time |"),
        F.lit("| --- | --- |"),
    ]
    lines = [plain(line) for line in lines]
    lines.append(timed("| All runs together |", F.col("total_wall")))
    for key, label in TIMING_ROWS:
        value = stage(key)
        head = f"| {label} |"
        line = F.when(value.isNotNull(), timed(head, value))
        if key in ("preparation", "inference"):
            line = timed(head, value)
        elif key in STEPS:
            line = line.when(
                ~split & stage("preparation").isNotNull(),
                plain(F.lit(f"| {label} | only known as part of the total |")),
            )
        lines.append(line)
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    speed = F.coalesce(
        speed_text(F.col("real_time_factor")),
        F.when(stage("inference").isNotNull(), "- Real-time factor n/a"),
    )
    counts = F.concat(
        F.lit("- Chunks planned "), count("total_chunks"), F.lit(", ok "), count("chunks_ok"),
        F.lit(", silent "), count("chunks_no_speech"), F.lit(", failed "), count("chunks_failed"),
    )
    lines += [
        plain(F.lit("")),
        timed("- Audio analysed:", F.col("analysed_seconds")),
        F.when(speed.isNotNull(), plain(speed)),
        plain(F.lit("")),
        plain(F.lit("## Counts")),
        plain(F.lit("")),
        plain(counts),
        F.when(F.length("error") > 0, plain(F.concat(F.lit("- Error: "), "error"))),
    ]
    # One row per line first; the time format is then built once per line, not once per column.
    rows = versions.select(
        "job_id", F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "l")
    )
    in_table = F.col("l.text").startswith("|")
    timing = F.concat(
        F.col("l.text"), F.lit(" "), timing_text(F.col("l.seconds")), F.when(in_table, " |").otherwise("")
    )
    return rows.select(
        "job_id", "line_no", F.when(F.col("l.timed"), timing).otherwise(F.col("l.text")).alias("line")
    )


def run_rows(runs: DataFrame) -> DataFrame:
    """The runs table of a report, one line per run in order of their start.

    ``runs(job_id, run_no, started, ended, wall_seconds, status)``.
    """
    ordered = numbered(
        runs, ["job_id"], ["run_no"], F.floor(F.col("run_no") / 65536), "line_no", first=1
    )
    cells = [
        F.coalesce("started", F.lit("n/a")),
        F.coalesce("ended", F.lit("in progress")),
        timing_text(F.col("wall_seconds")),
        F.coalesce("status", F.lit("n/a")),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return ordered.select("job_id", "line_no", line.alias("line"))


def timings_line(total: Column, stages: Column) -> Column:
    part = lambda label, key: F.when(
        stages[key].isNotNull(), F.concat(F.lit(f"{label} "), duration_text(stages[key]))
    )
    return F.concat(
        F.lit("Timings: "),
        F.concat_ws(
            " | ",
            F.concat(F.lit("total "), duration_text(total)),
            part("preparation", "preparation"),
            part("inference", "inference"),
            part("export", "export"),
        ),
    )


def run_log(events: DataFrame) -> DataFrame:
    """Readable log lines of ``log``, ``warning`` and run events; all others are dropped.

    ``events(run_id, seq, ts string, type, data string)`` with ``data`` as JSON.
    """
    get = lambda key, default: F.coalesce(F.get_json_object("data", f"$.{key}"), F.lit(default))
    kind = F.col("type")
    body = (
        F.when(kind == "log", F.concat(F.lit("["), get("level", "info"), F.lit("] "), get("message", "")))
        .when(kind == "warning", F.concat(F.lit("[warning] "), get("message", "")))
        .when(
            kind == "run.started",
            F.concat(
                F.lit("[run] started "), F.col("run_id"), F.lit(": command="), get("command", "None"),
                F.lit(" model="), get("model", "None"), F.lit(" backend="), get("backend", "None"),
                F.lit(" queue="), get("queue_size", "None"),
            ),
        )
        .when(
            kind == "run.finished",
            F.concat(
                F.lit("[run] finished: exit="), get("exit_status", "None"), F.lit(" wall="),
                get("wall_seconds", "None"), F.lit("s"),
            ),
        )
    )
    return events.where(kind.isin("log", "warning", "run.started", "run.finished")).select(
        "run_id", "seq", F.concat(F.col("ts"), F.lit(" "), body).alias("line")
    )
