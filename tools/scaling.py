"""Planning time when the recordings are replicated: python tools/scaling.py [sf] [factor …].

The last run gives one recording a third of all frames.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from longtake.operators import segmentation as seg
from longtake.plans import views
from longtake.session import local_session, stage
from longtake.settings import DEFAULT


def recordings_of(frames):
    return frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).select(
        "rec_id",
        F.lit(0.032).alias("frame_seconds"),
        F.lit(0.5).alias("threshold"),
        (F.col("n") * 0.032).alias("total_seconds"),
    )


def timed(label, frames):
    frames = stage(frames)
    recs = stage(recordings_of(frames))
    rows = frames.count()
    began = time.time()
    runs = stage(seg.speech_runs(frames, recs, DEFAULT))
    middle = time.time()
    seg.plan_spans(frames, recs, DEFAULT).write.format("noop").mode("overwrite").save()
    print(f"{label}: {rows} frames, runs {middle - began:.1f}s, whole plan {time.time() - middle:.1f}s", flush=True)
    return runs


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.1"
    factors = [int(x) for x in sys.argv[2:]] or [1, 10, 100]
    spark = local_session(8)
    base = stage(views.frames(spark, f"/root/testdata/sf{sf}"))
    timed("warm", base)
    for n in factors:
        copies = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        timed(f"x{n}", copies.select((F.col("rec_id") + F.col("copy") * 1_000_000).alias("rec_id"), "frame_idx", "prob"))
    total = base.count() * factors[-1]
    hot = spark.range(total // 2).select(
        F.lit(-1).cast("long").alias("rec_id"),
        F.col("id").alias("frame_idx"),
        (F.pmod(F.xxhash64(F.floor(F.col("id") / 9)), F.lit(100)) / 100.0).alias("prob"),
    )
    timed("one third in one recording", copies.select((F.col("rec_id") + F.col("copy") * 1_000_000).alias("rec_id"), "frame_idx", "prob").unionByName(hot))


if __name__ == "__main__":
    main()
    sys.stdout.flush()
    os._exit(0)
