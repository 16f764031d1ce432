"""One key with most of the rows, and results that do not depend on the number of partitions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from longtake.operators import metrics, percentiles, recovery, segmentation as seg, signal
from longtake.operators.ordered import neighbours, numbered, running
from longtake.operators.percentiles import exact_percentiles
from longtake.session import stage
from longtake.settings import InferenceSettings, SegmentationSettings
from longtake.streaming import watch


@pytest.fixture()
def partitions(spark):
    """Set the number of shuffle partitions without letting Spark merge small ones."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n) for n in names}

    def choose(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "false")
        spark.conf.set(names[2], "-1")

    yield choose
    for n, value in before.items():
        spark.conf.set(n, value)


def hot_frames(spark):
    rng = random.Random(9)
    rows = []
    for rec, n in ((1, 3000), (2, 40), (3, 40)):
        level = 0.0
        for i in range(n):
            level = rng.random() if rng.random() < 0.1 else level
            rows.append((rec, i, level))
    frames = stage(spark.createDataFrame(rows, "rec_id long, frame_idx long, prob double"))
    recs = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).select(
        "rec_id", F.lit(0.032).alias("frame_seconds"), F.lit(0.5).alias("threshold"), (F.col("n") * 0.032).alias("total_seconds")
    )
    return frames, stage(recs)


def test_plan_is_the_same_at_any_partition_count(spark, partitions):
    frames, recs = hot_frames(spark)
    s = SegmentationSettings(max_chunk_seconds=1.0, speech_pad_seconds=0.032, min_silence_seconds=0.08, block_frames=128)
    seen = []
    for n in (1, 2, 8):
        partitions(n)
        seen.append(sorted(tuple(r) for r in seg.plan_spans(frames, recs, s).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 50


def spread_of(df, condition):
    placed = stage(df.withColumn("p", F.spark_partition_id()))
    return placed.where(condition).select("p").distinct().count()


def test_a_hot_key_is_spread_over_tasks(spark, partitions):
    frames, recs = hot_frames(spark)
    partitions(8)
    block = F.floor(F.col("frame_idx") / 64)
    hot = F.col("rec_id") == 1
    assert spread_of(running(frames, ["rec_id"], ["frame_idx"], block, {"s": ("sum", F.lit(1))}), hot) >= 4
    assert spread_of(numbered(frames, ["rec_id"], ["frame_idx"], block, "no"), hot) >= 4
    limits = seg.frame_limits(recs, SegmentationSettings())
    assert spread_of(seg._scored(frames, limits, 64, ["onset"]), hot) >= 4
    samples = frames.select("rec_id", F.col("frame_idx").alias("pos"), F.lit(3).alias("value"))
    assert spread_of(signal.frame_energy(samples, 300), hot) >= 4


def test_a_hot_key_after_a_shuffle_on_that_key(spark, partitions):
    """Rows that are already together by key are spread again for the blocks."""
    frames, recs = hot_frames(spark)
    partitions(8)
    together = frames.join(recs.select("rec_id", "threshold"), "rec_id")
    block = F.floor(F.col("frame_idx") / 64)
    assert spread_of(numbered(together, ["rec_id"], ["frame_idx"], block, "no"), F.col("rec_id") == 1) >= 4


def test_hot_percentiles_and_summaries(spark, partitions):
    frames, _ = hot_frames(spark)
    want = None
    for n in (1, 8):
        partitions(n)
        got = sorted(tuple(r) for r in exact_percentiles(frames, ["rec_id"], F.col("prob"), {"p": (0.9, "nearest")}).collect())
        want = want or got
        assert got == want
    attempts = frames.select(
        F.col("rec_id").alias("job_id"), F.floor(F.col("frame_idx") / 3).alias("chunk_idx"), (F.col("frame_idx") % 3).alias("attempt_no"),
        F.lit("").alias("part"), F.lit(None).cast("string").alias("action"), F.lit("base").alias("stage"), F.lit("ok").alias("outcome"),
        F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("wall_seconds"), F.lit(None).cast("double").alias("audio_seconds"),
        F.struct(F.when(F.col("frame_idx") % 2 == 0, 4.0).alias("completion_tokens"), F.lit("stop").alias("finish_reason"),
                 F.col("prob").alias("mean_token_prob"), F.lit(0).cast("long").alias("logprob_tokens")).alias("metrics"),
    )
    plan = attempts.select("job_id", "chunk_idx").distinct()
    done = plan.withColumn("segments", F.array(F.lit(1)))
    stages = plan.select("job_id", F.lit(None).cast("double").alias("inference_seconds"), F.lit(0.0).alias("analysed_seconds")).distinct()
    row = metrics.execution_summary(plan, done, plan.where("false"), attempts, stages).where("job_id = 1").first()
    assert (row.total_chunks, row.chunks_ok, row.attempts, row.token_calls) == (1000, 1000, 3000, 1500)
    assert (row.request_seconds_sum, row.audio_seconds_sent, row.tokens_sum, row.tokens_p95) == (3000.0, 0.0, 6000.0, 4.0)
    assert row.real_time_factor is None and row.effective_concurrency is None


def test_a_value_that_holds_most_of_a_key_is_one_row(spark, partitions):
    """Nine of ten values are the floor level: no task reads more than its share of the rest."""
    partitions(8)
    rows = spark.range(40_000).select(
        F.lit("k").alias("key"), F.when(F.col("id") % 10 > 0, -90.0).otherwise(-F.col("id") / 1000.0).alias("v")
    )
    found = exact_percentiles(stage(rows), ["key"], F.col("v"), {"low": (0.5, "nearest"), "high": (0.95, "nearest")}).first()
    assert (found.n, found.low, found.high) == (40_000, -90.0, sorted(-i / 1000.0 if i % 10 == 0 else -90.0 for i in range(40_000))[37_999])
    counted = rows.groupBy("key", "v").count()
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(32)))
    assert salted.groupBy("salt").count().agg(F.max("count")).first()[0] < 3 * counted.count() / 32


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_summaries_of_many_short_keys_are_not_broadcast(spark):
    """Files of few bytes may hold many keys: what is carried from block to block is merged, not sent to every task."""
    frames, _ = hot_frames(spark)
    block = F.floor(F.col("frame_idx") / 64)
    assert broadcasts(running(frames, ["rec_id"], ["frame_idx"], block, {"s": ("sum", F.lit(1))})) == 0
    assert broadcasts(neighbours(frames, ["rec_id"], ["frame_idx"], block, before={"p": F.col("prob")})) == 0
    # The bounds of keys with many values only, which both uses of the placed values show.
    assert broadcasts(exact_percentiles(frames, ["rec_id"], F.col("prob"), {"p": (0.9, "nearest")})) <= 2


def test_scans_meet_their_results_without_a_broadcast(spark):
    seen = stage(spark.range(20).select(*[F.col("id").alias(c) for c in ("path", "scan", "size", "mtime")]))
    results = stage(seen.select("path", "scan", F.lit("failed").alias("status")))
    assert broadcasts(watch.stable_files(seen, results)) == 0


def test_chunks_of_a_ladder_are_not_sent_through_the_driver(spark, tmp_path):
    chunks = stage(spark.range(40).select((F.col("id") % 4).alias("job_id"), F.floor(F.col("id") / 4).alias("chunk_idx"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    for run in (1, 2):
        result = recovery.run_ladder(chunks, recovery.mock_transcriber, InferenceSettings(), log=str(tmp_path / "log"))
        assert result.done.count() == 40 and [broadcasts(df) for df in (result.failed, result.jobs)] == [0, 0]


def test_batches_of_long_payloads_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("256m", str(4 << 20)), ("1m", "1m")):
            spark.conf.set(name, given)
            rows = spark.range(3).select(F.col("id").alias("job_id"), F.lit(0).cast("long").alias("chunk_idx"), F.lit("").alias("part"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
            assert recovery.transcribe(rows, recovery.mock_transcriber).count() == 3
            assert spark.conf.get(name).rstrip("b") in (want, str(1 << 20) if given == "1m" else want)
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("whole", [0, 2, 4096])
def test_percentiles_in_blocks_or_whole(spark, monkeypatch, whole):
    """Keys with few values make one block; rows without a key have no percentile."""
    monkeypatch.setattr(percentiles, "WHOLE", whole, raising=False)
    rows = [(k, float(i % 50)) for k in ("a", "b") for i in range(300)] + [("c", 1.0), (None, 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    found = exact_percentiles(df, ["key"], F.col("v"), {"p": (0.5, "nearest"), "l": (0.5, "linear")})
    assert sorted(tuple(r) for r in found.collect()) == [("a", 300, 24.0, 24.5), ("b", 300, 24.0, 24.5), ("c", 1, 1.0, 1.0)]


def test_running_totals_over_all_blocks_of_a_key(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("pos"))
    got = running(rows, ["key"], ["pos"], F.floor(F.col("pos") / 10), {"n": ("total", F.lit(1)), "i": ("sum", F.lit(1))})
    assert {(r.key, r.n) for r in got.collect()} == {(0, 34), (1, 33), (2, 33)} and got.where("i = n").count() == 3


def test_windows_of_a_long_array_take_linear_time(spark):
    def seconds(n):
        rows = stage(spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double")).alias("s")))
        began = time.monotonic()
        signal.frame_windows(rows, "s").write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    seconds(200_000)
    assert seconds(1_600_000) < 16 * max(seconds(200_000), 0.25)


def test_runs_on_both_sides_of_a_block(spark, monkeypatch):
    """One huge run and middling ones: each is cut by its own length, borders included."""
    rows, recs = [], []
    for rec, n in enumerate((63, 64, 65, 700, 30)):
        rows += [(rec, i, 0.9 if i % 9 else 0.3) for i in range(n)]
        recs.append((rec, 0.032, 0.5, n * 0.032))
    frames = stage(spark.createDataFrame(rows, "rec_id long, frame_idx long, prob double"))
    recordings = spark.createDataFrame(recs, "rec_id long, frame_seconds double, threshold double, total_seconds double")
    s = SegmentationSettings(max_chunk_seconds=0.64, speech_pad_seconds=0.032, min_silence_seconds=0.08)
    runs = stage(seg.speech_runs(frames, recordings, s))
    cut = lambda levels: sorted(tuple(r) for r in seg.split_runs(runs, frames, recordings, s, levels=levels).collect())
    whole = cut((1 << 16, 1 << 28))
    assert len(whole) > 30 and cut((64, 256)) == whole == cut((32, 128))
