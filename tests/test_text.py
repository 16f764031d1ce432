from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from longtake.functions import columns as fx
from longtake.operators import quality, render
from longtake.session import stage


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_durations(spark):
    values = [None, float("nan"), 0.048, 0.4, 59.9, 59.94, 59.95, 59.96, 61.0, 3903.0, -3.0, 12.35, 12.25, 0.25]
    want = ["n/a", "n/a", "48 ms", "0.4 s", "59.9 s", "59.9 s", "1 min 00 s", "1 min 00 s", "1 min 01 s", "1 h 05 min 03 s", "0 ms", "12.3 s", "12.2 s", "0.2 s"]
    assert column(spark, values, "double", fx.duration_text) == want
    assert column(spark, [262.4, 0.01, 5.0, None], "double", fx.timing_text) == ["4 min 22 s (262.4 s)", "10 ms", "5.0 s", "n/a"]


def test_one_decimal_is_exact(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(0, 5000), 2) for _ in range(2000)] + [k / 20 for k in range(2000)]
    assert column(spark, values, "double", fx.one_decimal) == [f"{v:.1f}" for v in values]


def test_clock_rounds_half_to_even(spark):
    assert column(spark, [0.0005, 0.0015, 3661.25, 86400.0], "double", lambda c: fx.clock(c, ",")) == [
        "00:00:00,000", "00:00:00,002", "01:01:01,250", "24:00:00,000"]


def test_levels_and_messages(spark):
    lines = ["Failed x", "a FAILED", "b -> job fails", "Could not y", "Skipped: already completed", "Skipped: big", "fine"]
    assert column(spark, lines, "string", fx.classify_level) == ["error"] * 3 + ["warning", "info", "warning", "info"]
    assert column(spark, [" a \n b\t", "x" * 201], "string", fx.short_message) == ["a b", "x" * 199 + "..."]


def test_words_fold_case_and_sharp_s(spark):
    assert column(spark, ["Straße ÉTÉ_1, o'clock"], "string", fx.folded_words) == [["strasse", "été_1", "o", "clock"]]


def test_scope_labels(spark):
    rows = [(None, 0.0), (600.0, 0.0), (1.5, 0.0), (-1.0, 0.0), (None, 12.5), (30.0, 5.0)]
    df = spark.createDataFrame(rows, "m double, s double")
    got = [r.l for r in df.select(fx.scope_label(F.col("m"), F.col("s")).alias("l")).collect()]
    assert got == ["full", "first600s", "first1p5s", "unknown", "from12p5s-rest", "from5s-first30s"]


def test_repetition_is_measured_on_whole_texts(spark):
    texts = ["short", "word " * 400, "The quick brown fox jumps over a lazy dog near the old mill by the river."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = quality.repetition_gate(df).orderBy("i").collect()
    assert [r.loops for r in rows] == [False, True, False]
    assert rows[0].compression_ratio is None


def test_echo_needs_six_words_in_a_row(spark):
    prompts = spark.createDataFrame([(1, "one two three four five six seven")], "item_id int, text string")
    texts = ["x ONE two, three four five six y", "one two three four five", "two three four five six seven", "six five four three two one"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert sorted(r.i for r in quality.find_echoes(df, prompts, "i").collect()) == [0, 2]


@pytest.mark.parametrize(
    "typed, code",
    [("it", "it"), (" ITALIAN ", "it"), ("ingles", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("Türkçe", "tr"), ("klingon", None), ("persa", "fa")],
)
def test_languages(spark, typed, code):
    df = spark.createDataFrame([(typed,)], "typed string")
    rows = quality.normalise_language(df, "typed").collect()
    assert [r.code for r in rows] == [code]


def test_json_answers_must_have_exactly_one_key(spark):
    answers = ['{"transcript": " hi "}', '{"transcript": 5}', '{"transcript": "a", "x": 1}', "no", '{"transcript": ""}', None]
    df = spark.createDataFrame([(i, a, "stop", "json") for i, a in enumerate(answers)], "i int, content string, finish_reason string, mode string")
    got = [(r.text, r.status) for r in quality.normalise_responses(df).orderBy("i").collect()]
    assert got == [("hi", "ok"), (None, "degenerate"), (None, "degenerate"), (None, "degenerate"), ("", "no_speech"), (None, "degenerate")]


def transcripts(spark, jobs):
    return spark.createDataFrame(
        [(j, b, "m", 9.0, []) for j, b in jobs], "job_id long, backend string, model string, duration double, warnings array<string>"
    )


SEGMENT = "job_id long, seg_idx long, start double, end double, text string, speaker string, timing_source string"


def content(rows, job, fmt):
    parts = sorted((r for r in rows if r.job_id == job and r.format == fmt), key=lambda r: r.part_no)
    return "".join(r.content for r in parts)


def test_subtitles(spark):
    segs = spark.createDataFrame(
        [(1, 0, 0.0, 1.5, "a <b> & c\n\n  d ", " Ann  Lee ", "chunk"), (1, 1, 1.5, 2.0, "e", None, "word")], SEGMENT
    )
    rows = render.render(transcripts(spark, [(1, "server"), (2, "mock")]), segs, "vtt, srt, txt").collect()
    assert content(rows, 1, "srt") == "1\n00:00:00,000 --> 00:00:01,500\n[Ann Lee] a <b> & c\nd\n\n2\n00:00:01,500 --> 00:00:02,000\ne\n\n"
    assert content(rows, 1, "vtt").startswith("WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.500\n[Ann Lee] a &lt;b&gt; &amp; c\nd\n\n")
    assert (content(rows, 2, "vtt"), content(rows, 2, "srt"), content(rows, 2, "txt")) == ("WEBVTT\n\n", "", "")


def test_parts_join_to_the_whole_file(spark, monkeypatch):
    segs = stage(spark.createDataFrame([(1, i, float(i), i + 0.5, f"t{i}", None, "word") for i in range(25)], SEGMENT))
    heads = transcripts(spark, [(1, "server")])
    whole = render.render(heads, segs, "md,srt,json").collect()
    monkeypatch.setattr(render, "PART_CUES", 4)
    parts = render.render(heads, segs, "md,srt,json").collect()
    assert len(parts) > len(whole)
    for fmt in ("md", "srt", "json"):
        assert content(parts, 1, fmt) == content(whole, 1, fmt)


def test_formats():
    assert render.parse_formats("json, txt,txt") == ["txt", "json"]
    for wrong in ("", "doc", []):
        with pytest.raises(ValueError):
            render.parse_formats(wrong)


def test_run_report_has_a_fixed_order(spark):
    schema = (
        "job_id int, name string, version string, model string, status string, completion_percent double, total_wall double, "
        "stages_seconds map<string,double>, analysed_seconds double, real_time_factor double, total_chunks int, chunks_ok int, "
        "chunks_no_speech int, chunks_failed int, error string"
    )
    rows = [
        (1, "a.wav", "v1", "m", "completed", 100.0, 262.4, {"preparation": 60.0, "speech_detection": 44.2, "inference": 188.5}, 7546.0, 0.025, 581, 580, 1, 0, None),
        (2, "b.wav", "v2", "m", "failed", None, None, {"preparation": 3.0}, None, None, None, None, None, None, "disk full"),
    ]
    lines = render.run_report(spark.createDataFrame(rows, schema)).orderBy("job_id", "line_no").collect()
    first = [r.line for r in lines if r.job_id == 1]
    assert first[6] == "- Completion: 100%"
    assert first[12:16] == [
        "| All runs together | 4 min 22 s (262.4 s) |", "| Preparing, all steps | 1 min 00 s (60.0 s) |",
        "| > finding speech | 44.2 s |", "| Transcribing | 3 min 08 s (188.5 s) |",
    ]
    assert "- Real-time factor 0.025, that is 40.0x faster than the recording plays" in first
    second = [r.line for r in lines if r.job_id == 2]
    assert sum("only known as part of the total" in x for x in second) == 3
    assert second[-1] == "- Error: disk full" and "| All runs together | n/a |" in second


def test_summary_lines(spark):
    from longtake.operators import metrics

    df = spark.createDataFrame(
        [(1, "completed", 4, 3, 1, 0, 0.91, 12.5, None), (2, "failed", None, None, None, None, None, None, "no model")],
        "job_id int, status string, total_chunks int, chunks_ok int, chunks_no_speech int, chunks_failed int, confidence double, wall_seconds double, error string",
    )
    got = [r.line for r in metrics.summary_lines(df).orderBy("job_id").collect()]
    assert got == ["completed | 1 | chunks ok=3 no_speech=1 failed=0 of 4 | confidence 0.91 | wall 12.5s", "failed | 2 | error: no model"]
