"""Features of sample tables ``samples(rec_id, pos, value)`` with 16-bit values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SegmentationSettings
from .percentiles import SALTS, exact_percentiles

FULL_SCALE = 32768.0
# Fixed values of the level analysis.
FRAME_SECONDS = 0.03
FLOOR_DB = -90.0
MIN_THRESHOLD_DB = -55.0
HEADROOM_DB = 6.0
RAMP_DB = 10.0
WINDOW_SAMPLES = 512


def frame_windows(df: DataFrame, column: str, frame: int = WINDOW_SAMPLES) -> DataFrame:
    """Fixed windows of an array column, the last one padded with zeros; row by row, no shuffle.

    Every window is cut from the array itself and only the last is copied to be padded, so the work
    grows with the length of the array.
    """
    size = F.size(column)
    count = F.ceil(size / frame).cast("int")
    last = F.slice(column, (count - 1) * frame + 1, frame)
    padded = F.concat(last, F.array_repeat(F.lit(0.0), count * frame - size))
    full = F.transform(
        F.slice(F.sequence(F.lit(0), count - 1), 1, count - 1), lambda i: F.slice(column, i * frame + 1, frame)
    )
    windows = F.concat(full, F.array(padded))
    kept = [c for c in df.columns if c != column]
    return df.where(size > 0).select(*kept, F.posexplode(windows).alias("window_idx", "samples"))


def frame_samples(rate: int) -> int:
    return max(1, round(FRAME_SECONDS * rate))


def frame_energy(samples: DataFrame, rate: int) -> DataFrame:
    """Level of each frame in dB below full scale, never under the floor; the last may be short.

    Squares are summed as whole numbers, so the result does not depend on the order of rows.
    """
    n = frame_samples(rate)
    square = F.col("value").cast("long") * F.col("value").cast("long")
    framed = samples.groupBy("rec_id", F.floor(F.col("pos") / n).cast("long").alias("frame_idx")).agg(
        F.sum(square).alias("power"), F.count(F.lit(1)).alias("n")
    )
    level = 10.0 * F.log10(F.col("power") / F.col("n") / (FULL_SCALE * FULL_SCALE))
    return framed.select(
        "rec_id",
        "frame_idx",
        F.when(F.col("power") > 0, F.greatest(F.lit(FLOOR_DB), level)).otherwise(FLOOR_DB).alias("level_db"),
    )


def energy_probability(levels: DataFrame, s: SegmentationSettings) -> DataFrame:
    """Adaptive threshold per recording, and each level as a probability around it."""
    found = exact_percentiles(
        levels, ["rec_id"], F.col("level_db"), {"noise": (0.10, "linear"), "speech": (0.95, "linear")}
    )
    limits = found.select(
        "rec_id",
        F.greatest(
            F.lit(MIN_THRESHOLD_DB),
            F.least(F.col("noise") + s.energy_margin_db, F.col("speech") - HEADROOM_DB),
        ).alias("threshold_db"),
    )
    delta = (F.col("level_db") - F.col("threshold_db")) / RAMP_DB
    up = s.threshold + (1.0 - s.threshold) * F.least(F.lit(1.0), delta)
    down = s.threshold * F.greatest(F.lit(0.0), 1.0 + delta)
    return levels.join(limits, "rec_id").select(
        "rec_id", "frame_idx", "level_db", "threshold_db", F.when(delta >= 0, up).otherwise(down).alias("prob")
    )


def binned_peak(df: DataFrame, value: Column, bins: int, *, at_most_rows: bool = False) -> DataFrame:
    """Largest value in each of ``bins`` equal-count bins of positions; empty bins read 0.

    ``df(rec_id, pos, …)`` with positions from 0. ``at_most_rows`` uses no more bins than rows.
    """
    counts = df.groupBy("rec_id").agg(F.count(F.lit(1)).alias("__n"))
    wide = F.lit(bins).cast("long")
    counts = counts.withColumn("__b", F.least(wide, F.col("__n")) if at_most_rows else wide)
    place = F.floor(((F.col("pos") + 1) * F.col("__b") - 1) / F.col("__n")).cast("long")
    # Counts are repeated per salt, so a long recording is not joined in one task.
    repeated = counts.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    peaks = (
        df.select("rec_id", "pos", value.alias("__v"), F.pmod("pos", F.lit(SALTS).cast("long")).alias("__salt"))
        .join(repeated, ["rec_id", "__salt"])
        .groupBy("rec_id", place.alias("bin"))
        .agg(F.max("__v").alias("peak"))
    )
    if at_most_rows:
        return peaks
    grid = counts.select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)).alias("bin"))
    return grid.join(peaks, ["rec_id", "bin"], "left").select(
        "rec_id", "bin", F.coalesce("peak", F.lit(0.0)).alias("peak")
    )


def waveform(samples: DataFrame, bins: int = 800) -> DataFrame:
    """Sample peaks between 0 and 1."""
    return binned_peak(samples, F.abs(F.col("value")) / FULL_SCALE, bins)


def activity_curve(frames: DataFrame, points: int = 600) -> DataFrame:
    """Speech probability peaks, a coarse picture only."""
    curve = binned_peak(
        frames.withColumnRenamed("frame_idx", "pos"), F.col("prob"), points, at_most_rows=True
    )
    return curve.withColumn("peak", F.round("peak", 2))


def split_point(
    samples: DataFrame,
    keys: list[str],
    rate: int,
    *,
    window_seconds: float = FRAME_SECONDS,
    min_seconds: float = 2.0,
) -> DataFrame:
    """Centre of the quietest window in the middle of each chunk; null when too short to split.

    A chunk never exceeds the longest chunk length, so its samples are a bounded group. Window
    sums are differences of one running sum.
    """
    w = max(1, round(window_seconds * rate))
    step = max(1, rate // 1000)
    inside = Window.partitionBy(*keys).orderBy("pos")
    square = F.col("value").cast("long") * F.col("value").cast("long")
    upto = F.sum(square).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    summed = samples.select(*keys, "pos", "value", upto.alias("upto"), n.alias("n")).withColumn(
        "energy", F.lead("upto", w - 1).over(inside) - F.col("upto") + square
    )
    half = w // 2
    low = F.greatest(F.lit(0), F.floor(F.col("n") * 0.3) - half)
    high = F.least(F.col("n") - w, F.floor(F.col("n") * 0.7) - half)
    start = F.col("pos")
    candidate = (start >= low) & (start <= high) & ((start - low) % step == 0)
    middle = F.floor(F.col("n") / 2) - half
    best = F.min(F.when(candidate, F.struct(F.col("energy"), F.abs(start - middle), start.alias("start"))))
    cut = F.least(F.greatest(F.col("best.start") + half, F.lit(1)), F.col("n") - 1)
    return (
        summed.groupBy(*keys)
        .agg(best.alias("best"), F.max("n").alias("n"))
        .select(
            *keys,
            F.when(
                F.col("n") / rate >= min_seconds,
                F.when(F.col("best").isNull(), F.floor(F.col("n") / 2)).otherwise(cut),
            )
            .cast("long")
            .alias("cut"),
        )
    )


def cue_at(points: DataFrame, cues: DataFrame, width: float = 10.0) -> DataFrame:
    """The first cue with ``start <= t < end`` at each point, or null.

    ``points(job_id, point_id, t)``, ``cues(job_id, cue_idx, start, end, …)``. Both sides meet on
    time buckets, so the inequality never becomes a nested loop.
    """
    placed = cues.where(F.col("end") > F.col("start")).select(
        "job_id",
        "cue_idx",
        "start",
        "end",
        F.explode(
            F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))
        ).alias("bucket"),
    )
    bucketed = points.withColumn("bucket", F.floor(F.col("t") / width).cast("long"))
    hits = (
        bucketed.join(placed, ["job_id", "bucket"])
        .where((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
        .groupBy("job_id", "point_id")
        .agg(F.min("cue_idx").alias("cue_idx"))
    )
    return points.join(hits, ["job_id", "point_id"], "left")


def sample_windows(
    samples: DataFrame,
    rate: int,
    count: int,
    seconds: float,
    seed: int,
    *,
    attempts: int = 24,
    min_peak_db: float = -45.0,
    min_mean_db: float = -60.0,
) -> DataFrame:
    """Up to ``count`` windows per recording from its middle part that carry a signal.

    Candidates come from a hash of (seed, recording, attempt), so a rerun finds the same ones;
    each is measured with a bucketed join, and the few measurements of a recording are then
    taken in order, skipping what overlaps an accepted window.
    """
    length = max(1, round(seconds * rate))
    sizes = samples.groupBy("rec_id").agg((F.max("pos") + 1).alias("n"))
    duration = F.col("n") / rate
    span = F.least(F.lit(seconds), duration)
    lower = F.least(duration * 0.35, duration - span)
    upper = F.greatest(lower, F.least(duration * 0.65, duration - span))
    # 52 bits of a digest that every engine has.
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rec_id").cast("string"), F.col("k").cast("string")))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)
    candidates = sizes.select(
        "rec_id", "n", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("k")
    ).select("rec_id", "k", (lower + unit * (upper - lower)).alias("start"), span.alias("span"))
    first = F.floor(F.col("start") * rate).cast("long")
    placed = candidates.withColumn("first", first).withColumn(
        "bucket",
        F.explode(
            F.sequence(F.floor(first / length).cast("long"), F.floor((first + length - 1) / length).cast("long"))
        ),
    )
    square = F.col("value").cast("long") * F.col("value").cast("long")
    measured = (
        samples.withColumn("bucket", F.floor(F.col("pos") / length).cast("long"))
        .join(placed, ["rec_id", "bucket"])
        .where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + length))
        .groupBy("rec_id", "k", "start", "span")
        .agg(F.max(F.abs("value")).alias("peak"), F.sum(square).alias("power"), F.count(F.lit(1)).alias("n"))
    )
    decibel = lambda x: F.when(x > 0, 20.0 * F.log10(x)).otherwise(float("-inf"))
    peak_db = decibel(F.col("peak") / FULL_SCALE)
    mean_db = decibel(F.sqrt(F.col("power") / F.col("n")) / FULL_SCALE)
    window = F.struct(
        F.col("k").alias("k"),
        F.col("start").alias("start"),
        (F.col("start") + F.col("span")).alias("end"),
        peak_db.alias("peak_db"),
        mean_db.alias("mean_db"),
        ((peak_db >= min_peak_db) & (mean_db >= min_mean_db)).alias("signal"),
    )
    listed = measured.groupBy("rec_id").agg(F.sort_array(F.collect_list(window)).alias("w"))
    taken = F.aggregate(
        "w",
        F.slice("w", 1, 0),
        lambda acc, x: F.when(
            x["signal"]
            & (F.size(acc) < count)
            & ~F.exists(acc, lambda a: F.abs(a["start"] - x["start"]) < seconds),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )
    return listed.select("rec_id", F.posexplode(taken).alias("sample_no", "w")).select(
        "rec_id", "sample_no", F.col("w.k").alias("attempt"), "w.start", "w.end", "w.peak_db", "w.mean_db"
    )
