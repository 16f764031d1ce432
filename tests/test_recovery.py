from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from longtake.operators import answers, quality, recovery
from longtake.operators.recovery import DegenerateError, TransientError
from longtake.session import stage
from longtake.settings import InferenceSettings

SETTINGS = InferenceSettings(prompt="say it", retries=1, fallback_temperatures=(0.2, 0.4))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(j, i, i * 4.0, i * 4.0 + 4.0) for j in (1, 2) for i in range(4)]
    return stage(spark.createDataFrame(rows, "job_id long, chunk_idx long, start double, end double"))


def ladder(chunks, answer, settings=SETTINGS, splitter=None):
    result = recovery.run_ladder(chunks, lambda: answer, settings, splitter=splitter or recovery.split_in_middle())
    stages = {}
    for r in result.attempts.orderBy("job_id", "chunk_idx", "attempt_no").collect():
        stages.setdefault((r.job_id, r.chunk_idx), []).append((r.part, r.action or r.stage, r.outcome))
    return result, stages, {r.job_id: r.status for r in result.jobs.collect()}


def test_everything_at_once(chunks):
    result, stages, status = ladder(chunks, lambda c: [] if c.chunk_idx == 0 else [(c.start, c.end, "x")])
    assert status == {1: "completed", 2: "completed"}
    assert all(len(s) == 1 for s in stages.values()) and stages[(1, 0)][0][2] == "no_speech"
    assert result.done.count() == 8 and result.failed.count() == 0


def test_rungs_come_in_order_and_split_parts_climb_them_too(chunks):
    def answer(c):
        if c.job_id == 1 and c.chunk_idx == 2 and not (c.part == "a" or (c.part == "b" and c.temperature == 0.2)):
            raise DegenerateError("repetition loop")
        return [(c.start, c.end, c.part or "whole")]

    result, stages, status = ladder(chunks, answer)
    assert stages[(1, 2)] == [
        ("", "base", "degenerate"), ("", "temperature", "degenerate"), ("", "temperature", "degenerate"),
        ("", "split", "ok"), ("a", "base", "ok"), ("b", "base", "degenerate"), ("b", "temperature", "ok"),
    ]
    segments = result.done.where("job_id = 1 and chunk_idx = 2").first().segments
    assert [(s.start, s.end, s.text) for s in segments] == [(8.0, 10.0, "a"), (10.0, 12.0, "b")]
    assert status == {1: "completed", 2: "completed"}


def test_a_failed_first_part_ends_the_chunk(chunks):
    def answer(c):
        if c.job_id == 2 and c.chunk_idx == 1:
            raise DegenerateError("no content")
        return [(c.start, c.end, "x")]

    result, stages, status = ladder(chunks, answer)
    assert [s for s in stages[(2, 1)] if s[0] == "b"] == []
    assert status == {1: "completed", 2: "incomplete"}
    gap = result.failed.collect()
    assert [(g.job_id, g.chunk_idx, g.error) for g in gap] == [(2, 1, "no content")]


def test_no_context_call_only_after_an_echo(chunks):
    def answer(c):
        if c.chunk_idx == 3 and c.use_prompt:
            raise DegenerateError("repeats the instruction prompt" if c.job_id == 1 else "loop")
        return [(c.start, c.end, "x")]

    settings = InferenceSettings(prompt="p", retries=0, fallback_temperatures=(), split_on_failure=False)
    _, stages, status = ladder(chunks, answer, settings)
    assert stages[(1, 3)] == [("", "base", "degenerate"), ("", "no_context", "ok")]
    assert stages[(2, 3)] == [("", "base", "degenerate")]
    assert status == {1: "completed", 2: "incomplete"}


def test_transient_errors_repeat_the_call_and_then_fail_the_job(chunks):
    calls = {}

    def answer(c):
        if c.job_id == 1 and c.chunk_idx == 0:
            raise TransientError("offline")
        if c.job_id == 2 and c.chunk_idx == 0:
            calls["n"] = calls.get("n", 0) + 1
            if calls["n"] == 1:
                raise TransientError("busy")
        return [(c.start, c.end, "x")]

    result, stages, status = ladder(chunks, answer)
    assert stages[(1, 0)] == [("", "base", "transient")] * 2
    assert stages[(2, 0)] == [("", "base", "transient"), ("", "base", "ok")]
    assert status == {1: "failed", 2: "completed"}
    assert result.done.where("job_id = 1").count() == 3


def test_other_errors_fail_the_job_at_once(chunks):
    def answer(c):
        if c.job_id == 1:
            raise KeyError("bug")
        return [(c.start, c.end, "x")]

    _, stages, status = ladder(chunks, answer)
    assert status == {1: "failed", 2: "completed"}
    asked = [s for (job, _), s in stages.items() if job == 1]
    assert asked and all(len(s) == 1 for s in asked)  # a task asks nothing more for the job


def test_split_at_the_quietest_point(spark):
    rate = 100
    rows = [(1, 0, p, 5 if 120 <= p < 125 else 900) for p in range(300)]
    samples = stage(spark.createDataFrame(rows, "job_id long, chunk_idx long, pos long, value int"))
    chunk = spark.createDataFrame([(1, 0, 10.0, 13.0, "")], "job_id long, chunk_idx long, start double, end double, part string")
    parts = recovery.split_at_quietest(samples, rate)(chunk).orderBy("part").collect()
    assert [(p.part, round(p.start, 3), round(p.end, 3)) for p in parts] == [("a", 10.0, 11.23), ("b", 11.23, 13.0)]


def test_scorer_blocks_with_warm_up_equal_one_pass(spark):
    rows = [(r, i, [float((r * 7 + i * 3) % 11)]) for r in (1, 2) for i in range(50)]
    windows = stage(spark.createDataFrame(rows, "rec_id long, window_idx long, samples array<double>"))

    def load():
        def score(samples, state):
            kept = ((state or []) + [samples[0]])[-3:]
            return max(kept), kept

        return score

    one = recovery.score_frames(windows, load)
    many = recovery.score_frames(windows, load, warm_up=2, block=8)
    assert one.count() == 100
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert many.select(F.max("frame_idx")).first()[0] == 49


def test_after_an_outage_the_rest_is_kept_and_the_next_run_asks_only_what_is_open(spark, tmp_path):
    """As one task per job works through eight chunks, two at a time."""
    rows = [(j, i, i * 4.0, i * 4.0 + 4.0) for j in (1, 2) for i in range(8)]
    chunks = stage(spark.createDataFrame(rows, "job_id long, chunk_idx long, start double, end double"))
    settings = InferenceSettings(retries=0, parallel_requests=2)
    log = str(tmp_path / "log")

    def away(c):
        if c.job_id == 1 and c.chunk_idx == 3:
            raise TransientError("server down")
        return [(c.start, c.end, "first")]

    result = recovery.run_ladder(chunks, lambda: away, settings, tasks=1, log=log)
    assert {r.job_id: r.status for r in result.jobs.collect()} == {1: "failed", 2: "completed"}
    done = {r.chunk_idx for r in result.done.where("job_id = 1").collect()}
    asked = {r.chunk_idx for r in result.attempts.where("job_id = 1").collect()}
    assert 3 in asked and done == asked - {3} and len(done) < 7  # some were never asked
    again = recovery.run_ladder(chunks, lambda: lambda c: [(c.start, c.end, "second")], settings, tasks=3, log=log)
    assert {r.job_id: r.status for r in again.jobs.collect()} == {1: "completed", 2: "completed"}
    texts = {(r.job_id, r.chunk_idx): r.segments[0].text for r in again.done.collect()}
    assert len(texts) == 16 and {i for (j, i), t in texts.items() if t == "second"} == set(range(8)) - done
    assert again.attempts.count() == 16
    calls = recovery.AnswerLog(log).read(spark)
    assert calls.count() == 16 + 1 and calls.where("run = 1").count() == 8 - len(done)
    third = recovery.run_ladder(chunks, lambda: lambda c: 1 / 0, settings, log=log)
    assert third.done.count() == 16 and third.jobs.where("status = 'completed'").count() == 2


def test_a_failed_chunk_gets_a_fresh_attempt_and_given_answers_stay(chunks):
    settings = InferenceSettings(retries=0, fallback_temperatures=(), split_on_failure=False)

    def loops(c):
        if c.chunk_idx == 2:
            raise DegenerateError("loop")
        return [(c.start, c.end, "first")]

    first = recovery.run_ladder(chunks, lambda: loops, settings)
    assert {r.status for r in first.jobs.collect()} == {"incomplete"}
    second = recovery.run_ladder(
        chunks, lambda: lambda c: [(c.start, c.end, "second")], settings, done=first.done, attempts=first.attempts
    )
    assert {r.status for r in second.jobs.collect()} == {"completed"} and second.failed.count() == 0
    texts = {(r.job_id, r.chunk_idx): r.segments[0].text for r in second.done.collect()}
    assert {k for k, t in texts.items() if t == "second"} == {(1, 2), (2, 2)} and len(texts) == 8
    assert [r.outcome for r in second.attempts.collect()] == ["ok"] * 8


def test_turns_leave_lost_jobs_out(chunks):
    def away(c):
        if c.job_id == 1 and c.chunk_idx == 1:
            raise TransientError("server down")
        return [(c.start, c.end, "x")]

    result = recovery.run_ladder(chunks, lambda: away, SETTINGS, tasks=8, turn_chunks=2)
    asked = {(r.job_id, r.chunk_idx) for r in result.attempts.collect()}
    assert asked == {(1, 0), (1, 1), *((2, i) for i in range(4))}


def test_raw_answers_are_read_inside_the_call(chunks):
    prompt = "please write down every single word that is said"
    loop = "again and " * 30

    def answer(c):
        if c.job_id == 2:
            return answers.Answer([{"type": "text", "text": " first "}, {"type": "image"}, {"text": "second"}])
        first = [loop, prompt + " hello", "", "cut"][c.chunk_idx]
        return answers.Answer(first if c.use_prompt and c.temperature is None else "fine", "length" if first == "cut" and c.temperature is None else "stop")

    settings = InferenceSettings(prompt=prompt, retries=0, fallback_temperatures=(0.2,))
    result, stages, status = ladder(chunks, answer, settings)
    assert status == {1: "completed", 2: "completed"}
    assert [o for _, _, o in stages[(1, 0)]] == [o for _, _, o in stages[(1, 1)]] == [o for _, _, o in stages[(1, 3)]] == ["degenerate", "ok"]
    assert [o for _, _, o in stages[(1, 2)]] == ["no_speech"]
    assert {r.segments[0].text for r in result.done.where("job_id = 2").collect()} == {"first second"}
    errors = {r.chunk_idx: r for r in result.attempts.where("job_id = 1 and attempt_no = 0").collect()}
    assert errors[0].metrics.compression_ratio > 2.4 and errors[3].metrics.finish_reason == "length" and "prompt" in errors[1].error


def test_calls_and_tables_read_answers_alike(spark):
    long = " ".join(f"word{i}" for i in range(20))
    rows = [
        ('{"transcript": " a b "}', "json", "stop"), ('{"transcript": 3}', "json", "stop"), ('{"transcript": "a", "b": 1}', "json", "stop"),
        ("[1]", "json", "stop"), ("nothing", "json", "stop"), (None, "json", "stop"), ("x", "json", "length"), ('{"transcript": ""}', "json", "stop"),
        ("  plain\n", "plain", "stop"), ("", "plain", "stop"), (long, "plain", None), (None, "plain", "stop"),
        ("language German<asr_text> ja ", "tagged", "stop"), ("language None<asr_text>", "tagged", "stop"), ("Language none", "tagged", "stop"),
        ("language None<asr_text>text", "tagged", "stop"), ("no tag", "tagged", "stop"), ("language <asr_text>x", "tagged", "stop"),
    ]
    table = quality.normalise_responses(spark.createDataFrame(rows, "content string, mode string, finish_reason string"))
    expected = {(r.content, r.mode, r.finish_reason): (r.status, r.text, r.detected_language) for r in table.collect()}
    forced = quality.normalise_responses(spark.createDataFrame(rows, "content string, mode string, finish_reason string"), F.lit("german"))
    for name, want in (("german", {(r.content, r.mode, r.finish_reason): (r.status, r.text, r.detected_language) for r in forced.collect()}), (None, expected)):
        for content, mode, finish in rows:
            try:
                text, language = answers.read_answer(answers.Answer(content, finish, name), InferenceSettings(response_mode=mode), None, {})
                got = ("ok" if text else "no_speech", text, language)
            except DegenerateError:
                got = ("degenerate", None, None)
            assert got == want[content, mode, finish], (content, mode, name)


def test_a_lost_task_repeats_only_its_own_portion(spark, tmp_path):
    """A worker that dies once takes no other task's answers with it."""
    rows = [(1, i, float(i), i + 1.0) for i in range(12)]
    chunks = stage(spark.createDataFrame(rows, "job_id long, chunk_idx long, start double, end double"))
    folder = str(tmp_path)

    def load():
        def model(call):
            with open(f"{folder}/asked-{call.chunk_idx}", "a") as out:
                out.write("x")
            return [(call.start, call.end, "x")]

        return model

    result = recovery.run_ladder(chunks, load, InferenceSettings(), portion=3)
    assert result.done.count() == 12 and result.attempts.count() == 12 and result.jobs.first().status == "completed"
    assert all((tmp_path / f"asked-{i}").read_text() == "x" for i in range(12))  # reading the result asks nobody again


@pytest.mark.parametrize("kind", ["forgets", "toggles", "never forgets"])
def test_blocks_of_a_recording_meet_the_single_pass(spark, kind):
    rows = [(r, i, [float((r * 7 + i * i) % 13)]) for r in (1, 2) for i in range(300 if r == 1 else 25) if not 100 <= i < 130]
    windows = stage(spark.createDataFrame(rows, "rec_id long, window_idx long, samples array<double>"))

    def load():
        def forgets(samples, state):
            kept = ((state or []) + [samples[0]])[-3:]
            return max(kept), kept

        def toggles(samples, state):  # on above 10, off under 2, else as before
            on = samples[0] > 10 or (bool(state) and samples[0] >= 2)
            return float(on), on

        def adds(samples, state):
            value = (state or 0.0) + samples[0]
            return value, value

        return {"forgets": forgets, "toggles": toggles, "never forgets": adds}[kind]

    one = {(r.rec_id, r.frame_idx): r.prob for r in recovery.score_frames(windows, load).collect()}
    for lead, block in ((2, 40), (0, 70)):
        many = recovery.score_in_blocks(windows, load, lead=lead, block=block).collect()
        assert {(r.rec_id, r.frame_idx): r.prob for r in many} == one and len(many) == len(rows)
