from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from model import plan

from longtake.operators import segmentation as seg
from longtake.session import stage
from longtake.settings import DEFAULT, TIGHT, SegmentationSettings

FS = 0.032


def activity(rng, longest):
    out = []
    for _ in range(rng.randint(1, 30)):
        level = rng.choice([0.0, 0.2, 0.4, 0.6, 0.95, None])
        out += [rng.random() if level is None else level for _ in range(rng.randint(1, longest))]
    return out


def tables(spark, recordings):
    rows = [(r, i, float(p)) for r, (probs, *_) in recordings.items() for i, p in enumerate(probs)]
    frames = spark.createDataFrame(rows, "rec_id long, frame_idx long, prob double")
    dims = [(r, FS, onset, total) for r, (_, onset, total) in recordings.items()]
    recs = spark.createDataFrame(
        dims, "rec_id long, frame_seconds double, threshold double, total_seconds double"
    )
    return stage(frames), stage(recs)


def planned(frames, recs, s, levels):
    runs = stage(seg.speech_runs(frames, recs, s))
    pieces = stage(seg.split_runs(runs, frames, recs, s, levels=levels))
    spans = stage(seg.pad_spans(stage(seg.runs_to_spans(pieces, recs, s)), s))
    merged = seg.merge_spans(spans, s, levels=levels)
    by_piece, by_span = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        by_piece[r.rec_id].append((r.start_frame, r.end_frame))
    for r in merged.collect():
        by_span[r.rec_id].append((r.start, r.end))
    return by_piece, by_span


SETTINGS = [
    DEFAULT,
    TIGHT,
    SegmentationSettings(2.0, 0.4, 0.1, 0.05, 0.6, 3.0),
    SegmentationSettings(5.0, 0.6, 0.5, 0.3, 0.0, 0.0),
    SegmentationSettings(0.05, 0.5, 0.03, 0.03, 0.2, 1.0),
]


WHOLE, SMALL = (1 << 16, (1 << 16, 1 << 28)), (64, (32, 256))


@pytest.mark.parametrize("number, blocks", [(1, WHOLE), *[(i, SMALL) for i in range(len(SETTINGS))]])
def test_plan_equals_the_sequential_definition(spark, number, blocks):
    """Blocks far smaller than a run give the same plan as one block per recording."""
    s = replace(SETTINGS[number], block_frames=blocks[0])
    rng = random.Random(number)
    recordings = {}
    for r in range(30):
        probs = activity(rng, rng.choice([5, 40, 120]))
        recordings[r] = (probs, s.threshold, len(probs) * FS * rng.choice([1, 1, 0.7, 1.3]))
    frames, recs = tables(spark, recordings)
    pieces, spans = planned(frames, recs, s, blocks[1])
    for r, (probs, onset, total) in recordings.items():
        want_pieces, want_spans = plan(probs, FS, onset, total, s)
        assert sorted(pieces[r]) == want_pieces, r
        assert sorted(spans[r]) == want_spans, r
        got = sorted(spans[r])
        assert all(0 <= a < b <= total + 1e-9 and b - a <= s.max_chunk_seconds + 1e-9 for a, b in got)
        assert all(x[1] <= y[0] + 1e-9 for x, y in zip(got, got[1:]))


def test_silence_gives_no_chunks_and_steady_speech_is_cut(spark):
    s = replace(TIGHT, block_frames=50)
    loud = [0.9] * 1000
    recordings = {1: ([0.0] * 300, 0.5, 300 * FS), 2: (loud, 0.5, 1000 * FS)}
    frames, recs = tables(spark, recordings)
    _, spans = planned(frames, recs, s, (40, 320))
    assert spans[1] == []
    assert sorted(spans[2]) == plan(loud, FS, 0.5, 1000 * FS, s)[1]


def test_quantise_and_fixed_chunks(spark):
    recs = spark.createDataFrame(
        [(1, FS, 0.5, 2.5)], "rec_id long, frame_seconds double, threshold double, total_seconds double"
    )
    fixed = seg.fixed_chunks(recs, 16000, 1.0).orderBy("chunk_idx").collect()
    assert [(r.start_sample, r.end_sample) for r in fixed] == [(0, 16000), (16000, 32000), (32000, 40000)]
    spans = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.0, 9.0)], "rec_id long, start double, end double")
    cut = seg.quantise(spans, recs, 16000, replace(DEFAULT, max_chunk_seconds=1.0)).orderBy("chunk_idx")
    assert [tuple(r) for r in cut.collect()] == [(1, 0, 8000, 16000), (1, 1, 16000, 32000)]


def test_settings_are_checked():
    for wrong in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            SegmentationSettings(max_chunk_seconds=wrong)
