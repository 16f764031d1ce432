"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from longtake.plans import views
from longtake.queries import registry
from longtake.session import local_session

HEADLINE = [
    "win_1_speech_runs",
    "win_2_split_runs",
    "win_5_merge_spans",
    "agg_7_prepared_profile",
    "agg_1_execution_summary",
    "agg_3_confidence_summary",
    "agg_10_latest_versions",
    "col_1_identity",
    "col_4_repetition_gate",
    "col_7_render_srt_txt",
    "join_1_pending_sources",
    "join_6_find_echoes",
    "join_7_cue_at",
    "win_8_energy_probability",
    "win_11_progress_series",
    "str_2_run_state",
    "str_2_run_state_stream",
    "str_4_stable_files",
    "udf_3_ladder",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    queries = registry.all_queries()
    # Start the JVM and the Python workers before the clock runs, on other tables where there are any.
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in ("win_7_fixed_chunks", "udf_1_score_frames", "str_2_finished_jobs", "win_13_counter_rate"):
        queries[name](spark, small if os.path.isdir(small) else folder).write.format("noop").mode("overwrite").save()
    times = {}
    # Reading and numbering the events, which the queries below share, is a figure of its own.
    for name, view in (("read_frames", views.frames), ("read_run_events", views.run_event_files)):
        began = time.time()
        view(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    main()
