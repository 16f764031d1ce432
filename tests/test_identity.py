from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from longtake.operators import catalog, identity, selection
from longtake.session import stage
from longtake.settings import DEFAULT, InferenceSettings


def test_key_hashes_size_head_and_tail(spark):
    blobs = [b"", b"abc", bytes(range(200)) * 3]
    df = spark.createDataFrame([(f"n{i}.wav", b) for i, b in enumerate(blobs)], "name string, content binary")
    for block in (64, 1 << 22):
        got = [r.source_key for r in identity.identify(df, block).orderBy("name").collect()]
        want = [
            hashlib.sha256(f"{len(b)}:".encode() + b[:block] + b[max(0, len(b) - block) :]).hexdigest()[:12] for b in blobs
        ]
        assert got == want


def test_names(spark):
    names = ["My talk (1).wav", "dir/.hidden", "...", "a" * 90 + ".mp3", "archive.tar.gz"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.s for r in df.orderBy("i").select(identity.safe_stem(F.col("n")).alias("s")).collect()]
    assert got == ["My_talk_1", "hidden", "media", "a" * 64, "archive.tar"]
    models = spark.createDataFrame([("ASR Model/1.7B (Q8)",), (None,), ("--",)], "m string")
    assert [r.s for r in models.select(identity.model_slug(F.col("m")).alias("s")).collect()] == ["asr-model-1.7b-q8", "unknown", "unknown"]


def test_fingerprint_ignores_defaults_of_optional_settings_and_the_runtime():
    base = InferenceSettings()
    same = replace(base, runtime={"device": "gpu"}, retries=9)
    assert identity.config_fingerprint(base, DEFAULT) == identity.config_fingerprint(same, DEFAULT)
    for change in ({"parallel_requests": 2}, {"collect_logprobs": True}, {"seed": 1}, {"start_seconds": 3.0}):
        assert identity.config_fingerprint(replace(base, **change), DEFAULT) != identity.config_fingerprint(base, DEFAULT)
    assert identity.config_fingerprint(base, replace(DEFAULT, block_frames=7)) == identity.config_fingerprint(base, DEFAULT)


def test_split_contract(spark):
    rows = [
        (1, 0, 0, 0.0, 2.0, 0.0, 4.0, "a"), (1, 0, 1, 2.0, 4.0, 0.0, 4.0, "b"),
        (1, 1, 0, 4.0, 6.0, 4.0, 8.0, "a"), (1, 1, 1, 5.9, 8.1, 4.0, 8.0, "b"),
        (1, 2, 0, 8.0, 9.0, 8.0, 10.0, ""), (1, 2, 1, float("nan"), 10.0, 8.0, 10.0, "b"),
    ]
    df = stage(spark.createDataFrame(rows, "job_id long, chunk_idx long, idx long, start double, end double, parent_start double, parent_end double, part string"))
    got = {(r.chunk_idx, r.idx): r.problem for r in identity.check_spans(df, "split").collect()}
    assert got[(0, 0)] is None and got[(0, 1)] is None and got[(1, 0)] is None
    assert got[(1, 1)] == "overlaps the span before it"
    assert got[(2, 0)] == "part has no label" and got[(2, 1)] == "times are not finite"


def test_force_takes_every_source(spark):
    sources = spark.createDataFrame([("k", "f")], "source_key string, fingerprint string")
    versions = spark.createDataFrame([("v", "k", "f", "completed")], "version string, source_key string, fingerprint string, status string")
    files = spark.createDataFrame([("v", n) for n in identity.REQUIRED_ARTIFACTS], "version string, name string")
    assert identity.pending_sources(sources, versions, files).count() == 0
    assert identity.pending_sources(sources, versions, files, force=True).count() == 1
    assert identity.pending_sources(sources, versions, files.where("name <> 'report.json'")).count() == 1


def test_selection_edges(spark):
    rows = [(0.0, 10.0005, 10.0), (0.0, 10.002, 10.0), (1.0, 1.04, 10.0), (2.0, 5.0, 10.0), (float("nan"), 5.0, 10.0)]
    df = spark.createDataFrame(rows, "start double, end double, duration double")
    got = [(r.valid, r.scope, r.selected_end) for r in selection.select_interval(df).collect()]
    assert got == [(True, "full", 10.0), (False, None, None), (False, None, None), (True, "bounded", 5.0), (False, None, None)]


def test_limit_comes_before_the_gate(spark):
    df = spark.createDataFrame([("b.wav", 5), ("A.wav", 50), ("c.wav", 1), ("d.wav", None)], "path string, length long")
    rows = selection.gate_sources(df, 10, 3).collect()
    assert [(r.path, r.rejected is None) for r in rows] == [("A.wav", False), ("b.wav", True), ("c.wav", True)]
    assert selection.gate_sources(df, 10).where("path = 'd.wav'").first().rejected == "could not be inspected"


def test_estimate_falls_back_to_the_default(spark):
    queue = spark.createDataFrame([(1, 1000.0), (2, None)], "id int, duration double")
    versions = spark.createDataFrame([], "source long, version long, status string, created timestamp, updated timestamp, rtf double")
    rows = catalog.estimate_queue(queue, versions).orderBy("id").collect()
    assert (rows[0].estimate_seconds, rows[0].estimate) == (40.0, "40.0 s")
    assert (rows[1].estimate_seconds, rows[1].estimate) == (None, None)


def test_files_of_any_size_have_the_key_of_their_ranges(spark, tmp_path):
    import hashlib

    data = {"a.wav": b"head" + b"x" * 90 + b"tail", "b.wav": b"short", "c.wav": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    big = tmp_path / "big.wav"
    with open(big, "wb") as out:  # mostly a hole: over 2 GB and no room taken
        out.write(b"first")
        out.seek((2 << 30) + 100)
        out.write(b"last!")
    rows = [(str(tmp_path / n), n) for n in [*data, "big.wav"]]
    found = identity.identify_files(spark.createDataFrame(rows, "path string, relative string"), 16)
    got = {r.relative: (r.source_key, r.stem) for r in found.collect()}
    content = spark.createDataFrame([(n, bytearray(c)) for n, c in data.items()], "name string, content binary")
    assert {n: k for n, (k, _) in got.items() if n != "big.wav"} == {r.name: r.source_key for r in identity.identify(content, 16).collect()}
    size = (2 << 30) + 105
    want = hashlib.sha256(f"{size}:".encode() + b"first" + b"\0" * 11 + b"\0" * 11 + b"last!").hexdigest()[:12]
    assert got["big.wav"] == (want, "big")
