from __future__ import annotations

import json
import os
import random
import threading
import types

import pandas as pd
import pytest

from pyspark.sql import functions as F

from longtake.operators import signal
from longtake.plans.views import stream_of
from longtake.session import stage
from longtake.sources import events as source
from longtake.sources import growing, media, state
from longtake.streaming import alarms, fold, held, jobs, series, tables, watch


def event(seq, kind, data=None, job="s/v", run="r"):
    return json.dumps(
        {"schema_version": 1, "seq": seq, "ts": f"2024-01-01T00:{seq // 60:02d}:{seq % 60:02d}.000Z", "elapsed_s": float(seq),
         "run_id": run, "job_id": job, "type": kind, "data": data or {}}
    )


LOG = [
    event(1, "run.started", {"command": "run", "model": "m"}, None),
    event(2, "job.started", {"source": "a.wav"}, "old"),
    event(3, "stage.started", {"stage": "probe"}, "old"),
    event(4, "job.finished", {"status": "failed"}, "old"),
    event(5, "job.started", {"source": "b.wav"}),
    event(6, "stage.started", {"stage": "preparation"}),
    event(7, "stage.finished", {"stage": "preparation", "seconds": 2.5}),
    event(8, "job.prepared", {"planned": 4}),
    event(9, "stage.started", {"stage": "inference"}),
    event(10, "chunk.started", {"index": 0}),
    event(11, "chunk.finished", {"index": 0, "outcome": "ok"}),
    event(12, "chunk.started", {"index": 1}),
    event(13, "warning", {"message": "careful"}),
    event(14, "chunk.finished", {"index": 1, "outcome": "no_speech"}),
    event(15, "chunk.started", {"index": 2}),
    event(16, "progress", {"percent": 50.0}),
]


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    lines = LOG + ['{"type": 3}', "not json", '{"seq": 4}']
    random.Random(2).shuffle(lines)
    for i in range(4):
        (folder / f"{i}.jsonl").write_text("\n".join(lines[i::4]) + "\n")
    return str(folder)


def test_fold(spark, log_dir):
    events = stage(source.read_events(spark, log_dir))
    assert events.count() == len(LOG)
    row = fold.run_state(stage(fold.run_headers(events)), fold.run_stages(events)).first()
    assert (row.state, row.last_seq, row.current_job, row.job_status, row.current_stage) == ("running", 16, "s/v", "running", "inference")
    assert (row.jobs_started, row.jobs_finished, row.warnings, row.command) == (2, 1, 1, "run")
    assert json.loads(row.progress) == {"percent": 50.0}
    stages = {r.stage: (r.state, r.seconds) for r in fold.stage_states(fold.run_headers(events), fold.run_stages(events)).collect()}
    assert stages == {"preparation": ("done", 2.5), "inference": ("running", None)}
    assert fold.chunk_map(fold.plans(events), fold.chunk_marks(events)).first().marks == "osa."


def test_stream_in_any_file_order_equals_the_table(spark, log_dir):
    stream = source.read_events(spark, log_dir, stream=True, files_per_trigger=1)
    headers = stage(jobs.latest_update(jobs.run_to_table(fold.run_headers(stream), mode="update"), ["run_id"]))
    stages = jobs.latest_update(jobs.run_to_table(fold.run_stages(stream), mode="update"), ["run_id", "stage"])
    events = stage(source.read_events(spark, log_dir))
    want = fold.run_state(stage(fold.run_headers(events)), fold.run_stages(events)).first()
    assert fold.run_state(headers, stages).first() == want


def test_type_prefix_and_round_trip(spark, log_dir, tmp_path):
    chunks = source.read_events(spark, log_dir, "chunk.")
    assert {r.type for r in chunks.collect()} == {"chunk.started", "chunk.finished"}
    source.event_lines(chunks).write.text(str(tmp_path / "again"))
    assert source.read_events(spark, str(tmp_path / "again")).count() == chunks.count()


def test_broken_lines_are_told_without_the_parser(spark):
    whole = event(1, "a}", {"x": {"y": [{"z": "\\"}]}, "t": '{"'})
    deep = '{"type": "deep", "data": ' + '{"k": ' * 9 + "1" + "}" * 10
    kept = [whole, deep, f" \t{whole}", f"{whole} junk", whole + "{", '{"type": "x"} "', '{"type": "x"}}', "{}" + whole]
    cut = [whole[:n] for n in range(len(whole)) if whole[n - 1] != "}"] + ["", "not json", "5", f"[{whole},", "{" * 5000, '{"type": "' + "\\n" * 500_000]
    broken = ["{'type': 'x'}", '{"type": "x", "type": "x"}', '{"type": NaN}', '{"type": "x", "data": {"a": 1, "a": 2}}', '{"type": "x" "y"}', "\ufeff" + whole]
    lines = [(i, x) for i, x in enumerate(kept + cut + broken)]
    df = stage(spark.createDataFrame(lines, "seq long, value string"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.type", "variant"))
    exact = {r.value for r in df.where(kind == "STRING").collect()}
    left = {r.value for r in df.where(source.may_parse(F.col("value"))).collect()}
    assert exact == set(kept[:-1]) and exact <= left and left.isdisjoint(cut)
    assert source.parse_events(df).count() == len(exact)


def test_stable_files_stream_equals_table_with_results(spark):
    rng = random.Random(4)
    rows = []
    for path in range(12):
        size = 0
        for scan in range(1, 40):
            if rng.random() < 0.15:
                continue  # not seen in this scan
            size = rng.randint(0, 2) if rng.random() < 0.25 else size
            status = rng.choice([None, None, "failed", "completed"])
            rows.append((path, scan, size, size, status))
    seen = stage(spark.createDataFrame(rows, "path long, scan long, size long, mtime long, status string"))
    results = seen.where("status is not null").select("path", "scan", "status")
    table = watch.stable_files(seen.drop("status"), results, stable_scans=2, retries=1)
    one_file = stage(seen.coalesce(1))
    stream = jobs.run_to_table(watch.stable_files_stream(stream_of(one_file, 1), stable_scans=2, retries=1))
    columns = ["path", "scan", "stable_count", "failures_before", "ready"]
    a, b = ({tuple(r) for r in df.select(*columns).collect()} for df in (table, stream))
    assert a == b and any(r[-1] for r in a)


def test_rate_history_and_gaps(spark):
    rows = [(1, i, v, t) for i, (v, t) in enumerate([(10, 100), (15, 120), (15, 120), (15, 130)])]
    df = spark.createDataFrame(rows, "host long, n long, idle long, total long")
    rated = series.counter_rate(df, ["host"], "n", F.floor(F.col("n") / 2)).orderBy("n")
    assert [r.cpu_percent for r in rated.collect()] == [None, 75.0, None, 100.0]
    kept = series.history(df, ["host"], "n", ["idle"], 2).collect()
    assert sorted(r.n for r in kept) == [2, 3]
    events = spark.createDataFrame([("r", s, "2024-01-01") for s in (1, 2, 2, 5)], "run_id string, seq long, ts string")
    assert [(r.seq, r.problem) for r in series.sequence_gaps(events).orderBy("seq").collect()] == [(2, "repeated"), (5, "missing before")]


def test_listing_and_state(spark, tmp_path):
    for name in ("a/B.WAV", "a/c.mp3", ".git/d.wav", "process/e.wav", "a/.f.wav", "g.txt", "H.flac", "_x/_y.wav"):
        target = tmp_path / "in" / name
        os.makedirs(target.parent, exist_ok=True)
        target.write_bytes(b"x" * 3)
    rows = media.list_media(spark, str(tmp_path / "in")).collect()
    assert [r.relative for r in rows] == ["_x/_y.wav", "a/B.WAV", "a/c.mp3", "H.flac"]
    assert all(r.length == 3 and open(r.path, "rb").read() == b"xxx" for r in rows)
    assert media.list_media(spark, f"{tmp_path}/nowhere").count() == 0
    docs = tmp_path / "state"
    docs.mkdir()
    (docs / "good.json").write_text('{\n "job_id": 1,\n "chunks": {"0": [], "2": [{"start": 0, "end": 1, "text": "x"}]}\n}')
    (docs / "bad.json").write_text('{"job_id": 1, "chunks"')
    found = state.done_chunks(state.read_state(spark, str(docs), state.CHECKPOINT)).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, len(r.segments)) for r in found] == [(0, 0), (2, 1)]


def test_waveform_and_curve_bins(spark):
    rng = random.Random(6)
    data = {r: [rng.randint(-9, 9) for _ in range(n)] for r, n in ((1, 5), (2, 40), (3, 97))}
    samples = stage(spark.createDataFrame([(r, i, v) for r, vs in data.items() for i, v in enumerate(vs)], "rec_id long, pos long, value int"))
    got = {(r.rec_id, r.bin): r.peak for r in signal.waveform(samples, 12).collect()}
    for r, vs in data.items():
        for b in range(12):
            part = vs[b * len(vs) // 12 : (b + 1) * len(vs) // 12]
            assert got[(r, b)] == max((abs(x) for x in part), default=0) / 32768
    windows = signal.sample_windows(samples.withColumn("value", F.col("value") * 1000), 10, 2, 0.5, 1).collect()
    again = signal.sample_windows(samples.withColumn("value", F.col("value") * 1000), 10, 2, 0.5, 1).collect()
    assert sorted(windows) == sorted(again) and windows
    for r in data:
        starts = [w.start for w in windows if w.rec_id == r]
        assert all(abs(a - b) >= 0.5 for i, a in enumerate(starts) for b in starts[:i])


def run_log(folder, name, lines):
    (folder / f".{name}").write_text("\n".join(lines) + "\n")
    (folder / f".{name}").rename(folder / name)


def test_follow_waits_for_the_end_or_fails(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    run_log(log, "a.jsonl", LOG)
    stream = source.read_events(spark, str(log), stream=True)
    with pytest.raises(TimeoutError):
        jobs.follow(stream, "r", f"{tmp_path}/early", every="100 milliseconds", timeout=2)
    late = threading.Timer(3, run_log, (log, "b.jsonl", [event(17, "run.finished", {}, None)]))
    late.start()
    copied = jobs.follow(stream, "r", f"{tmp_path}/whole", every="100 milliseconds")
    late.join()
    assert copied.count() == len(LOG) + 1

    class Broken(Exception):
        pass

    def fail(x):
        raise Broken

    broken = stream.withColumn("seq", F.udf(fail, "long")("seq"))
    with pytest.raises(Exception, match="Broken"):
        jobs.follow(broken, "r", f"{tmp_path}/broken", every="100 milliseconds")


def test_large_plans_have_a_map(spark):
    rows = [("r", 1, "job.prepared", '{"planned": 60000}'), ("r", 2, "chunk.started", '{"index": 59999}')]
    events = spark.createDataFrame(rows, "run_id string, seq long, type string, data string")
    parts = fold.chunk_map(fold.plans(events), fold.chunk_marks(events)).orderBy("part_no").collect()
    assert len(parts) == 60 and "".join(p.marks for p in parts) == "." * 59_999 + "a"


def test_every_batch_reaches_a_sink_and_failures_are_kept(spark, log_dir, tmp_path):
    events = stage(source.read_events(spark, log_dir).repartition(3))
    registry = jobs.SinkRegistry()
    registry.add("good", jobs.to_table(f"{tmp_path}/sink"))

    def broken(batch, batch_id):
        raise RuntimeError(f"no place for batch {batch_id}")

    registry.add("broken", broken)
    jobs.start(stream_of(events, 1), registry).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sink/batch=*").count() == len(LOG)
    assert len(registry.errors["broken"]) == registry.failures["broken"] > 1
    assert registry.errors["broken"][0] == (0, "no place for batch 0")


def test_late_scans_of_named_files_change_nothing(spark, tmp_path):
    schema = "path string, scan long, size long, mtime long, status string"
    first = [("/a.wav", 1, 5, 5, None), ("/a.wav", 2, 5, 5, None)]
    late = [("/a.wav", 1, 9, 9, None), ("/a.wav", 3, 5, 5, None)]
    for rows in (first, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/seen")
        jobs.start(
            watch.stable_files_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/seen")),
            jobs.to_table(f"{tmp_path}/out{len(rows)}{rows[1][1]}"), checkpoint=f"{tmp_path}/state",
        ).awaitTermination()
    got = [tuple(r)[:5] for r in spark.read.parquet(f"{tmp_path}/out22/batch=*", f"{tmp_path}/out23/batch=*").orderBy("scan", "ready").collect()]
    assert sorted(got, key=str) == sorted(
        [("/a.wav", 1, 1, 0, False), ("/a.wav", 2, 2, 0, True), ("/a.wav", 1, None, None, False), ("/a.wav", 3, 3, 0, True)], key=str
    )


def test_missing_state_is_no_state(spark, tmp_path):
    assert state.read_state(spark, f"{tmp_path}/nowhere", state.CHECKPOINT).count() == 0


def test_written_views_follow_their_table(spark, tmp_path):
    from longtake import session
    from longtake.plans import views

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in (50, 80):
        events.limit(n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert views.frames(spark, str(tmp_path)).count() == n
    session.release(spark)
    assert views.frames(spark, str(tmp_path)).count() == 80


def test_a_growing_log_gives_each_line_once_it_is_finished(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    log = folder / "a.jsonl"

    def step():
        stream = source.read_events(spark, str(folder), stream=True, growing=True)
        jobs.start(stream, jobs.to_table(out), checkpoint=str(tmp_path / "progress")).awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(f"{out}/batch=*").collect())

    log.write_text(event(1, "log") + "\n" + event(2, "log")[:20])
    assert step() == [1]
    with log.open("a") as more:
        more.write(event(2, "log")[20:])
    assert step() == [1]  # whole, but its newline may still be to come
    with log.open("a") as more:
        more.write("\r\n" + event(3, "log") + "\n" + event(4, "l")[:5])
    (folder / "b.jsonl").write_text(event(10, "log") + "\n")
    (folder / "_c.jsonl").write_text(event(11, "log") + "\n")
    assert step() == [1, 2, 3, 10]
    log.write_text(event(20, "log") + "\n")  # replaced by another log, and shorter
    assert step() == [1, 2, 3, 10, 20]
    assert step() == [1, 2, 3, 10, 20]


def test_parts_of_a_growing_log_cover_each_line_once(tmp_path):
    rng = random.Random(7)
    texts = ["x" * rng.choice([0, 1, 5, 40, 300]) for _ in range(200)]
    path = tmp_path / "log"
    path.write_text("\n".join(texts) + "\nunfinished")
    for part_bytes in (1, 2, 7, 64, 1000, 10**6):
        reader = growing.GrowingLogReader({"path": str(tmp_path), "partBytes": str(part_bytes)})
        parts = reader.partitions({}, reader.latestOffset())
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [r["value"] for r in rows] == texts
        data = path.read_bytes()
        assert all(data[r["offset"] :].startswith(r["value"].encode() + b"\n") for r in rows)


def test_a_long_unfinished_line_stays_back(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "STEP", 16)
    path = tmp_path / "log"
    path.write_text("first line of some length\n" + "y" * 100)
    reader = growing.GrowingLogReader({"path": str(tmp_path)})
    [(crc, end)] = reader.latestOffset().values()
    assert end == 26
    with path.open("a") as more:
        more.write("y\nz")
    assert list(reader.latestOffset().values()) == [[crc, 26 + 102]]
    path.write_text("no newline at all")
    assert reader.latestOffset() == {}


EVENTS = "schema_version int, seq long, ts timestamp, elapsed_s double, run_id string, job_id string, type string, data string"


def rows_at(spark, rows):
    """Events of (run, seq, second, type[, data])."""
    made = [(1, r[1], float(r[2]), r[0], "s/v", r[3], json.dumps(r[4] if len(r) > 4 else {}), r[2]) for r in rows]
    table = spark.createDataFrame(made, "schema_version int, seq long, elapsed_s double, run_id string, job_id string, type string, data string, s double")
    return table.select("schema_version", "seq", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "elapsed_s", "run_id", "job_id", "type", "data")


def fed(spark, state, batches):
    for i, batch in enumerate(batches):
        state(rows_at(spark, batch), i)


def test_finished_and_forgotten_runs_leave_the_state(spark, tmp_path):
    state = tables.StateTable(str(tmp_path / "t"), fold.header_fold(), keep_seconds=100, forget_seconds=1000)
    started = [(f"r{i}", 1, 1.0, "run.started", {"model": "m"}) for i in range(5)]
    fed(spark, state, [started, [("r0", 2, 50.0, "run.finished", {"exit_status": "0"}), ("r1", 2, 60.0, "warning")]])
    assert state.live(spark).count() == 5
    state(rows_at(spark, [("r1", 3, 200.0, "run.finished")]), 2)
    assert {r.run_id for r in state.live(spark).collect()} == {"r1", "r2", "r3", "r4"}  # r0 ended 150 seconds ago
    state(rows_at(spark, [("z", 1, 5000.0, "run.started"), ("z", 2, 5000.0, "run.finished")]), 3)
    assert {r.run_id for r in state.live(spark).collect()} == {"z"}
    everything = {r.run_id: r for r in state.everything(spark).collect()}
    assert len(everything) == 6 and everything["r0"].exit_status == "0" and everything["r1"].warnings == 1
    state(rows_at(spark, [("z", 3, 9000.0, "log")]), 4)
    assert state.live(spark).count() == 1  # still seen, although it had ended
    state(rows_at(spark, [("y", 1, 9200.0, "run.finished")]), 5)
    state(rows_at(spark, [("y", 2, 9400.0, "run.finished"), ("x", 1, 9600.0, "run.finished")]), 6)
    assert {r.run_id for r in state.live(spark).collect()} == {"x"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    batches = [[("r", 1, 0.0, "run.started"), ("r", 2, 1.0, "job.started")], [("r", 3, 2.0, "warning"), ("r", 4, 3.0, "job.finished", {"status": "completed"})]]
    state = tables.StateTable(str(tmp_path / "t"), fold.header_fold())
    fed(spark, state, batches)
    once = state.live(spark).collect()
    state(rows_at(spark, batches[1]), 1)
    assert state.live(spark).collect() == once and once[0].warnings == 1 and once[0].jobs_finished == 1
    for i in range(2, 9):
        state(rows_at(spark, [("r", 3 + i, 3.0 + i, "log")]), i)
    assert len(state._versions(spark)) <= tables.VERSIONS_KEPT + 1


def test_the_shown_status_keeps_its_cadence(spark, tmp_path):
    state = tables.StateTable(str(tmp_path / "t"), fold.header_fold(), status_seconds=0.5)
    shown = lambda: state.status(spark).first().last_seq
    expected = []
    for i, (at, kind) in enumerate([(0.0, "run.started"), (0.2, "log"), (0.4, "log"), (0.6, "log"), (0.7, "log"), (0.8, "job.started"), (1.2, "log"), (1.3, "log")]):
        state(rows_at(spark, [("r", i + 1, at, kind)]), i)
        expected.append(shown())
    assert expected == [1, 1, 1, 4, 4, 6, 6, 8]
    assert state.live(spark).first().last_seq == 8


def test_a_chunk_map_survives_until_its_run_leaves(spark, tmp_path):
    state = tables.StateTable(str(tmp_path / "m"), fold.mark_fold(), keep_seconds=10, forget_seconds=10**6)
    chunk = lambda seq, at, kind, i, outcome=None: ("r", seq, at, kind, {"index": i, "outcome": outcome})
    fed(spark, state, [[chunk(1, 0.0, "chunk.started", 0), chunk(2, 1.0, "chunk.finished", 0, "ok")], [chunk(3, 9000.0, "chunk.started", 1)]])
    assert {(r.chunk_idx, r.mark) for r in state.live(spark).collect()} == {(0, "o"), (1, "a")}
    state(rows_at(spark, [("r", 4, 9001.0, "run.finished"), ("q", 1, 9100.0, "run.started")]), 2)
    assert state.live(spark).count() == 0 and state.everything(spark).count() == 2


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    """More batches than Spark keeps reports of."""
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        folder = str(tmp_path / "in")
        for i in range(6):  # every file but the first has rows an hour behind the one before
            rows = [("r", 10 * i, 7200.0 * i, "log")] + [("r", 10 * i + k, 7200.0 * (i - 1) - 3600.0 - k, "log") for k in range(1, 4) if i]
            rows_at(spark, rows).coalesce(1).write.mode("append").parquet(folder)
            os.utime(next(p for p in (tmp_path / "in").glob("*.parquet") if p.stat().st_mtime > 10**9), (i + 1, i + 1))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        query = jobs.start(jobs.ingest_events(stream, "10 minutes"), jobs.to_table(str(tmp_path / "out")))
        query.awaitTermination()
        written = spark.read.parquet(f"{tmp_path}/out/batch=*").count()
        assert jobs.dropped_late(query) == 21 - written > 0 and len(query.recentProgress) <= 2
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


def test_a_live_alarm_follows_the_clock(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows_at(spark, [("a", 1, 1.0, "run.started"), ("b", 1, 1.0, "run.started"), ("b", 2, 2.0, "run.finished"), ("c", 1, 1.0, "resource.sample")]).write.parquet(folder)
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    query = jobs.start(alarms.stall_alarms(stream, 1.0, forget_seconds=600), jobs.to_table(out), every="200 milliseconds")
    try:
        def found(n):
            for _ in range(150):
                rows = spark.read.schema(f"{alarms.ALARMS.split(', idle')[0]}, idle_from timestamp, at timestamp").parquet(f"{out}/batch=*").collect() if (tmp_path / "out").exists() else []
                if len(rows) >= n:
                    return sorted((r.run_id, r.kind, r.seq) for r in rows)
                threading.Event().wait(0.2)
            raise AssertionError("no alarm came")

        assert found(1) == [("a", "raised", None)]
        rows_at(spark, [("a", 2, 9.0, "log")]).write.mode("append").parquet(folder)
        assert found(2)[0] == ("a", "cleared", 2)
        assert ("a", "raised", None) in found(3)
    finally:
        query.stop()


def test_state_of_ordered_streams_ends(spark, tmp_path):
    """Paths that are not seen any more are forgotten, and finished runs hold no state."""
    schema = "path string, ts timestamp, scan long, size long, mtime long, status string"
    folder = str(tmp_path / "in")
    seconds = lambda s: F.timestamp_seconds(F.lit(s))
    make = lambda path, s, scan: spark.range(1).select(F.lit(path).alias("path"), seconds(s).alias("ts"), F.lit(scan).cast("long").alias("scan"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.lit(None).cast("string").alias("status"))
    make("a", 1000, 1).unionByName(make("b", 1000, 1)).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "1 minute")
    checkpoint = str(tmp_path / "progress")

    def step():
        query = jobs.start(watch.stable_files_in_order(stream, forget_days=1), jobs.to_table(str(tmp_path / "out")), checkpoint=checkpoint)
        query.awaitTermination()
        return query.lastProgress.stateOperators[0]

    step()
    make("c", 3 * 86_400, 2).write.mode("append").parquet(folder)
    step()
    make("c", 6 * 86_400, 3).write.mode("append").parquet(folder)
    last = step()
    answered = {(r.path, r.scan) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()}
    assert {("a", 1), ("b", 1), ("c", 2)} <= answered
    assert last.numRowsTotal <= 3  # of c only: its waiting scan or its row, and a timer
    assert spark.conf.get(held.PROVIDER) == held.ROCKSDB


class _Kept:
    """State and timers of one key, and how often its waiting rows were read."""

    def __init__(self):
        self.rows, self.value, self.timers, self.reads = [], None, set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return types.SimpleNamespace(
            exists=lambda: bool(self.rows), get=self._read, put=lambda r: setattr(self, "rows", list(r)),
            appendList=self.rows_added, clear=lambda: setattr(self, "rows", []),
        )

    def rows_added(self, rows):
        self.rows = self.rows + list(rows)

    def _read(self):
        self.reads += 1
        return iter(self.rows)

    def getValueState(self, name, schema):  # noqa: N802
        return types.SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_rows_that_wait_are_read_once_whatever_the_number_of_batches():
    kept, processor = _Kept(), watch._Ordered(2, 3, None)
    processor.init(kept)
    clock = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    batch = lambda *scans: iter([pd.DataFrame([(s * 60_000_000, s, 5, 5, None) for s in scans], columns=["at", "scan", "size_", "mtime", "status"])])
    for scans in ((7, 3), (5, 1), (6,), (2, 4)):
        assert not list(processor.handleInputRows(("a",), batch(*scans), clock(0)))
    assert kept.reads == 0 and len(kept.rows) == 7 and kept.timers == {60_001}
    out = pd.concat(processor.handleExpiredTimer(("a",), clock(6 * 60_000), None))
    assert out["scan"].tolist() == [1, 2, 3, 4, 5] and out["stable_count"].tolist() == [1, 2, 3, 4, 5]
    assert kept.reads == 1 and len(kept.rows) == 2 and kept.timers == {360_001}
    # A row that is ready meets those that have waited, in order.
    out = pd.concat(processor.handleInputRows(("a",), batch(9, 8), clock(8 * 60_000 + 1)))
    assert out["scan"].tolist() == [6, 7, 8] and kept.value[0] == 8 and kept.timers == {540_001}


@pytest.mark.parametrize(("files", "last"), [(10, "log"), (1, "resource.sample")])
def test_a_replay_to_the_end_leaves_out_no_event(spark, files, last):
    """Files that hold rows of every day each, and a last event that is no activity."""
    from longtake.queries.streaming import _to_the_end

    rng = random.Random(11)
    rows, want = [], set()
    for day in range(6):
        at, idle_from = 1_700_000_000 + 86_400 * day, None
        for seq in range(1, 41):
            at += rng.choice([60, 599, 600, 1500])
            kind = rng.choice(["log", "progress", "resource.sample", "run.finished"])
            if (day, seq) == (5, 40):
                kind = last
            rows.append((f"d{day}", seq, float(at), kind))
            if kind == "resource.sample":
                continue
            if idle_from is not None and at - idle_from >= 600:
                want |= {(f"d{day}", "raised", None, idle_from, idle_from + 600), (f"d{day}", "cleared", seq, idle_from, at)}
            idle_from = None if kind == "run.finished" else at
        if idle_from is not None:
            want.add((f"d{day}", "raised", None, idle_from, idle_from + 600))
    events = rows_at(spark, rows).repartition(files, "seq")
    found = _to_the_end(spark, events, lambda s: alarms.stall_alarms(s, 600, live=False)).where("run_id <> '~clock'")
    got = found.select("run_id", "kind", "seq", F.unix_seconds("idle_from"), F.unix_seconds("at")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
