"""From frame scores to a chunk plan: speech runs, cuts, padding, bounded merge.

``frames(rec_id, frame_idx, prob)`` and ``recordings(rec_id, frame_seconds, threshold,
total_seconds)`` go in; spans in seconds and finally whole-sample chunks come out. Frames are
shuffled once, on (recording, block of frames), so a very long recording is spread over many
tasks; everything after the first pass works on islands, runs or spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stage
from ..settings import (
    FRAME_COUNT_MARGIN,
    HYSTERESIS,
    LONGEST_SPEECH_MARGIN,
    SegmentationSettings,
)
from .chains import END, LEVELS, follow
from .ordered import cell, neighbours, numbered, running

RUN = ["rec_id", "run_start", "run_end"]


def frame_limits(recordings: DataFrame, s: SegmentationSettings) -> DataFrame:
    """Per recording: thresholds and every setting counted in frames."""
    fs = F.col("frame_seconds")
    eps = FRAME_COUNT_MARGIN

    def at_least_one(column: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), column.cast("long"))

    longest = F.greatest(fs, F.lit(s.max_chunk_seconds - 2 * s.pad - LONGEST_SPEECH_MARGIN))
    usable = (
        (F.col("total_seconds") > 0)
        & (F.col("total_seconds") < float("inf"))
        & (fs > 0)
        & (fs < float("inf"))
    )
    return recordings.where(usable).select(
        "rec_id",
        "frame_seconds",
        "total_seconds",
        F.col("threshold").alias("onset"),
        F.greatest(F.lit(0.0), F.col("threshold") - HYSTERESIS).alias("offset"),
        F.ceil(F.col("total_seconds") / fs - eps).cast("long").alias("frame_limit"),
        at_least_one(F.floor(longest / fs + eps)).alias("max_frames"),
        at_least_one(F.ceil(F.lit(s.min_silence_seconds) / fs - eps)).alias("end_frames"),
        at_least_one(F.floor(F.lit(s.min_silence_seconds) / fs + eps)).alias("cut_frames"),
        at_least_one(F.ceil(F.lit(s.min_speech_seconds) / fs - eps)).alias("min_frames"),
    )


def _scored(frames: DataFrame, limits: DataFrame, block_frames: int, columns: list[str]) -> DataFrame:
    """Frames with their recording's limits, joined on the cell (recording, block).

    Repeating the small side per block keeps one long recording from landing in one join task,
    and leaves the frames partitioned the way the windows after it need them.
    """
    last = F.floor((F.greatest(F.col("frame_limit"), F.lit(1)) - 1) / block_frames).cast("long")
    per_block = limits.select(
        "rec_id",
        "frame_limit",
        *columns,
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"),
    ).withColumn("cell", cell(["rec_id"], F.col("block")))
    block = F.floor(F.col("frame_idx") / block_frames).cast("long")
    placed = frames.withColumn("cell", cell(["rec_id"], block))
    return placed.join(per_block.drop("rec_id", "block"), "cell").where(
        F.col("frame_idx") < F.col("frame_limit")
    )


def speech_runs(
    frames: DataFrame, recordings: DataFrame, s: SegmentationSettings
) -> DataFrame:
    """Hysteresis runs ``(rec_id, run_start, run_end)`` in frames, before any cutting.

    Low stretches of at least ``end_frames`` separate the recording into pieces; in each piece
    the run goes from the first frame at or above the onset to the separator that follows, or in
    the last piece to its last frame that is not low.
    """
    limits = frame_limits(recordings, s)
    scored = _scored(frames, limits, s.block_frames, ["onset", "offset", "end_frames"]).select(
        "rec_id",
        "frame_idx",
        "cell",
        "end_frames",
        (F.col("prob") < F.col("offset")).alias("low"),
        (F.col("prob") >= F.col("onset")).alias("high"),
    )
    idx = F.col("frame_idx")
    anchored = running(
        scored,
        ["rec_id"],
        ["frame_idx"],
        "cell",
        {
            "last_low": ("max", F.when(F.col("low"), idx)),
            "last_other": ("max", F.when(~F.col("low"), idx)),
        },
    )
    anchor = F.coalesce(F.when(F.col("low"), F.col("last_other")).otherwise(F.col("last_low")), F.lit(-1))
    islands = stage(
        anchored.groupBy("rec_id", "low", anchor.alias("anchor"))
        .agg(
            F.min("frame_idx").alias("start"),
            F.count(F.lit(1)).alias("frames"),
            F.min(F.when(F.col("high"), idx)).alias("first_high"),
            F.max("end_frames").alias("end_frames"),
        )
        .where(~F.col("low") | (F.col("frames") >= F.col("end_frames")))
    )
    pieces = running(
        islands,
        ["rec_id"],
        ["start"],
        F.floor(F.col("start") / s.block_frames).cast("long"),
        {"separator": ("max", F.when(F.col("low"), F.col("start")))},
        exclusive=True,
    )
    return (
        pieces.groupBy("rec_id", F.coalesce("separator", F.lit(-1).cast("long")).alias("separator"))
        .agg(
            F.min("first_high").alias("run_start"),
            F.coalesce(
                F.max(F.when(F.col("low"), F.col("start"))),
                F.max(F.when(~F.col("low"), F.col("start") + F.col("frames"))),
            ).alias("run_end"),
        )
        .where(F.col("run_start").isNotNull())
        .select(*RUN)
    )


# --- cutting runs that are too long ---------------------------------------------------------

_LINK = "rec_id {key}, run_start long, run_end long, pos long, nxt long, piece_end long"


def _next_cuts(
    prob: np.ndarray, first: int, count: int, end: int, offset: float, max_frames: int, cut_frames: int
) -> tuple[np.ndarray, np.ndarray]:
    """For every start ``first … first+count-1``: where its piece ends and the next one starts.

    ``prob`` holds the frames from ``first`` on, far enough to see every cut. A piece ends at the
    last low stretch of at least ``cut_frames`` that starts within ``max_frames`` (a stretch
    already under way right after the start counts from there), else at the last of the lowest
    frames in the second half of the window.
    """
    n = len(prob)
    low = prob < offset
    position = np.arange(n)
    # End of the low stretch each frame belongs to.
    barrier = np.where(~low, position, n)
    stretch_end = np.minimum.accumulate(barrier[::-1])[::-1]
    stretch_end = np.where(low, stretch_end, position)
    opens = low & ~np.concatenate(([False], low[:-1]))
    usable = opens & (stretch_end - position >= cut_frames)
    last_open = np.maximum.accumulate(np.where(usable, position, -1))
    start = np.arange(count)
    piece_end = np.full(count, end - first)
    nxt = np.full(count, END)
    long = (end - first - start) > max_frames
    s = start[long]
    window_end = s + max_frames
    cut = last_open[np.minimum(window_end, n - 1)]
    cut = np.where(cut > s, cut, -1)
    # A stretch that already covers s+1 is measured from there.
    mid = low[s + 1] & (stretch_end[s + 1] - (s + 1) >= cut_frames) & ((cut < 0))
    cut = np.where(mid, s + 1, cut)
    by_dip = cut >= 0
    e, x = np.empty(len(s), dtype=np.int64), np.empty(len(s), dtype=np.int64)
    e[by_dip], x[by_dip] = cut[by_dip], stretch_end[cut[by_dip]]
    rest = np.flatnonzero(~by_dip)
    if len(rest):
        lower = np.maximum(1, max_frames // 2)
        width = max_frames - lower + 1
        windows = np.lib.stride_tricks.sliding_window_view(prob, width)
        for part in np.array_split(rest, max(1, len(rest) * width // 4_000_000)):
            view = windows[s[part] + lower]
            last_lowest = width - 1 - np.argmin(view[:, ::-1], axis=1)
            e[part] = x[part] = s[part] + lower + last_lowest
    piece_end[long], nxt[long] = e, x
    return piece_end + first, np.where(nxt == END, END, nxt + first)


def _cut_block(table: pa.Table) -> tuple[pa.Scalar, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Recording, run, and for every own frame of the block: position, next start, piece end."""
    idx = table["frame_idx"].to_numpy()
    order = np.argsort(idx)
    idx, prob = idx[order], table["prob"].to_numpy()[order]
    one = {c: table[c][0].as_py() for c in ("run_start", "run_end", "offset", "max_frames", "cut_frames")}
    count = len(idx) - sum(table["halo"].to_pylist()) if "halo" in table.column_names else len(idx)
    piece_end, nxt = _next_cuts(
        prob, int(idx[0]), count, one["run_end"], one["offset"], one["max_frames"], one["cut_frames"]
    )
    origin = one["run_start"]
    # A next start at the very end of the run leaves nothing to send.
    nxt = np.where((nxt == END) | (nxt >= one["run_end"]), END, nxt - origin)
    return table["rec_id"][0], origin, one["run_end"], idx[:count] - origin, nxt, piece_end


def _links(table: pa.Table) -> pa.Table:
    rec, origin, end, pos, nxt, piece_end = _cut_block(table)
    n = len(pos)
    return pa.table(
        {
            "rec_id": pa.repeat(rec, n),
            "run_start": pa.repeat(pa.scalar(origin), n),
            "run_end": pa.repeat(pa.scalar(end), n),
            "pos": pos,
            "nxt": nxt.astype(np.int64),
            "piece_end": piece_end.astype(np.int64),
        }
    )


def _pieces(table: pa.Table) -> pa.Table:
    """A run that fits one block: its links, walked at once."""
    rec, origin, _, _, nxt, piece_end = _cut_block(table)
    starts, here = [], 0
    while here != END:
        starts.append(here)
        here = int(nxt[here])
    return pa.table(
        {
            "rec_id": pa.repeat(rec, len(starts)),
            "start_frame": np.array(starts) + origin,
            "end_frame": piece_end[starts].astype(np.int64),
        }
    )


def split_runs(
    runs: DataFrame,
    frames: DataFrame,
    recordings: DataFrame,
    s: SegmentationSettings,
    *,
    levels: tuple[int, ...] = LEVELS,
    longest: int | None = None,
) -> DataFrame:
    """Cut runs longer than the longest chunk at their pauses: ``(rec_id, start_frame, end_frame)``.

    Only frames inside over-long runs reach Python, in blocks of bounded size. A block also sees
    the frames just after it, as far as one piece and its closing pause can reach. ``longest`` is
    the length of the longest run, where it is known already.
    """
    limits = frame_limits(recordings, s)
    sized = runs.join(
        limits.select("rec_id", "max_frames", "cut_frames", "end_frames", "offset"), "rec_id"
    )
    length = F.col("run_end") - F.col("run_start")
    if longest is None:
        longest = sized.agg(F.max(length)).first()[0] or 0
    whole = sized.where(length <= F.col("max_frames")).select(
        "rec_id", F.col("run_start").alias("start_frame"), F.col("run_end").alias("end_frame")
    )
    size = levels[0]
    grid = s.block_frames
    # Find each frame's run by the blocks of the frame axis the run touches.
    spread = sized.where(length > F.col("max_frames")).withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("run_start") / grid).cast("long"),
                F.floor((F.col("run_end") - 1) / grid).cast("long"),
            )
        ),
    )
    inside = (
        frames.withColumn("cell", F.floor(F.col("frame_idx") / grid).cast("long"))
        .join(spread, ["rec_id", "cell"])
        .where((F.col("frame_idx") >= F.col("run_start")) & (F.col("frame_idx") < F.col("run_end")))
        .drop("cell")
    )
    key = frames.schema["rec_id"].dataType.simpleString()
    # Each run that fits one block is cut in one task; only longer ones need links.
    run_length = F.col("run_end") - F.col("run_start")
    fitting = inside.where(run_length <= size).groupBy(*RUN)
    pieces = fitting.applyInArrow(_pieces, f"rec_id {key}, start_frame long, end_frame long")
    whole = whole.unionByName(pieces)
    if longest <= size:  # no other runs
        return whole.where(F.col("end_frame") > F.col("start_frame"))
    inside = inside.where(run_length > size)
    relative = F.col("frame_idx") - F.col("run_start")
    own = F.floor(relative / size).cast("long")
    reach = F.col("max_frames") + F.col("end_frames") + 1
    first = F.greatest(F.lit(0).cast("long"), F.floor((relative - reach) / size).cast("long"))
    touched = F.sequence(first, own)
    placed = inside.withColumn("own", own).withColumn("block", F.explode(touched)).withColumn(
        "halo", F.col("own") != F.col("block")
    )
    links = stage(placed.groupBy(*RUN, "block").applyInArrow(_links, _LINK.format(key=key)))
    taken = follow(links, RUN, longest, levels)
    pieces = links.join(taken.select(*RUN, "pos"), [*RUN, "pos"], "left_semi").select(
        "rec_id",
        (F.col("run_start") + F.col("pos")).alias("start_frame"),
        F.col("piece_end").alias("end_frame"),
    )
    return whole.unionByName(pieces).where(F.col("end_frame") > F.col("start_frame"))


def runs_to_spans(pieces: DataFrame, recordings: DataFrame, s: SegmentationSettings) -> DataFrame:
    """Drop pieces that are too short and turn frames into seconds."""
    limits = frame_limits(recordings, s).select("rec_id", "frame_seconds", "total_seconds", "min_frames")
    seconds = lambda c: F.least(F.col(c) * F.col("frame_seconds"), F.col("total_seconds"))
    return (
        pieces.join(limits, "rec_id")
        .where(F.col("end_frame") - F.col("start_frame") >= F.col("min_frames"))
        .select(
            "rec_id",
            "start_frame",
            seconds("start_frame").alias("start"),
            seconds("end_frame").alias("end"),
            "total_seconds",
        )
    )


def pad_spans(spans: DataFrame, s: SegmentationSettings) -> DataFrame:
    """Pad both sides; where padded neighbours overlap, both move to the middle of their gap."""
    return _padded(spans, s).drop("prev_end")


def _padded(spans: DataFrame, s: SegmentationSettings) -> DataFrame:
    """The padded spans, each with the padded end of the one before it."""
    pad = s.pad
    beside = neighbours(
        spans,
        ["rec_id"],
        ["start_frame"],
        F.floor(F.col("start_frame") / s.block_frames).cast("long"),
        before={"prev_end": F.col("end")},
        after={"next_start": F.col("start")},
    )
    wide_start = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad)
    wide_end = lambda c: F.least(F.col("total_seconds"), F.col(c) + pad)
    meets_before = F.col("prev_end").isNotNull() & (wide_start("start") < wide_end("prev_end"))
    middle = (F.col("prev_end") + F.col("start")) / 2
    return beside.select(
        "rec_id",
        "start_frame",
        F.when(F.col("prev_end").isNotNull(), F.when(meets_before, middle).otherwise(wide_end("prev_end"))).alias("prev_end"),
        F.when(meets_before, middle).otherwise(wide_start("start")).alias("start"),
        F.when(
            F.col("next_start").isNotNull() & (wide_start("next_start") < wide_end("end")),
            (F.col("end") + F.col("next_start")) / 2,
        )
        .otherwise(wide_end("end"))
        .alias("end"),
    )


# --- merging --------------------------------------------------------------------------------

ISLAND = ["rec_id", "island"]
FOLD_SPANS = 256


def _merge_links(max_chunk: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        start, end = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        n = len(pdf)
        # First span that no longer fits; searchsorted is corrected by the exact test.
        nxt = np.searchsorted(end, start + max_chunk, side="right")
        nxt = np.maximum(nxt, np.arange(n) + 1)
        for _ in range(2):
            back = (nxt - 1 > np.arange(n)) & ~(end[nxt - 1] - start <= max_chunk)
            nxt = np.where(back, nxt - 1, nxt)
            ahead = (nxt < n) & (end[np.minimum(nxt, n - 1)] - start <= max_chunk)
            nxt = np.where(ahead, nxt + 1, nxt)
        pos = pdf["pos"].to_numpy()
        own = ~pdf["halo"].to_numpy()
        return pd.DataFrame(
            {
                "rec_id": pdf["rec_id"],
                "island": pdf["island"],
                "pos": pos,
                "nxt": np.where(nxt < n, pos[np.minimum(nxt, n - 1)], END),
                "start": start,
                "end": np.minimum(end[nxt - 1], start + max_chunk),
            }
        )[own]

    return links


def _fold(members: DataFrame, max_chunk: float) -> DataFrame:
    """Greedy merge of groups of at most ``FOLD_SPANS`` spans, as a fold inside the JVM."""
    span = F.struct("start", "end")
    start = F.slice(F.col("spans"), 1, 0)

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), x["end"].alias("end"))
        return F.when(
            x["end"] - last["start"] <= max_chunk,
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)),
        ).otherwise(F.concat(acc, F.array(x)))

    listed = members.groupBy(*ISLAND).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    merged = listed.select("rec_id", F.explode(F.aggregate("spans", start, step)).alias("m"))
    return merged.select(
        "rec_id", "m.start", F.least(F.col("m.end"), F.col("m.start") + max_chunk).alias("end")
    )


def merge_spans(
    spans: DataFrame, s: SegmentationSettings, *, levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """Join spans left to right while the gap is small and the result still fits a chunk.

    Spans are first grouped at gaps that always separate them. A group of few spans is folded in
    place, and only groups of many spans that do not fit one chunk need the walk over blocks.
    """
    cells = F.floor(F.col("start_frame") / s.block_frames).cast("long")
    return _merge_marked(neighbours(spans, ["rec_id"], ["start_frame"], cells, before={"prev_end": F.col("end")}), s, levels)


def _merge_marked(spans: DataFrame, s: SegmentationSettings, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The merge of spans that know the end of the one before, ``prev_end``."""
    max_chunk, max_gap = s.max_chunk_seconds, s.max_merge_gap_seconds
    cells = F.floor(F.col("start_frame") / s.block_frames).cast("long")
    marked = spans.withColumn(
        "opens",
        F.col("prev_end").isNull() | ~(F.col("start") - F.col("prev_end") <= max_gap),
    )
    grouped = stage(running(
        marked,
        ["rec_id"],
        ["start_frame"],
        cells,
        {"island": ("max", F.when(F.col("opens"), F.col("start_frame")))},
    ).select("rec_id", "island", "start_frame", "start", "end"))
    extent = grouped.groupBy(*ISLAND).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("spans")
    )
    fits = F.col("end") - F.col("start") <= max_chunk
    short = F.col("spans") <= FOLD_SPANS
    if extent.where(~short).isEmpty():
        return _fold(grouped, max_chunk).where(F.col("end") > F.col("start"))
    extent = stage(extent)
    whole = extent.where(fits).select("rec_id", "start", "end")
    whole = whole.unionByName(_fold(grouped.join(extent.where(~fits & short).select(*ISLAND), ISLAND), max_chunk))
    whole = whole.where(F.col("end") > F.col("start"))
    wide = extent.where(~fits & ~short).select(*ISLAND, F.col("start").alias("island_start"))
    members = stage(numbered(grouped.join(wide, ISLAND), ISLAND, ["start_frame"], cells, "pos"))
    longest = members.agg(F.max("pos")).first()[0]
    key = spans.schema["rec_id"].dataType.simpleString()
    block_seconds = 4096 * max_chunk
    offset = F.col("start") - F.col("island_start")
    own = F.floor(offset / block_seconds).cast("long")
    # Far enough to see the first span that no longer fits the last chunk of a block.
    halo = 2 * max_chunk + max(0.0, max_gap)
    first = F.greatest(F.lit(0).cast("long"), F.floor((offset - halo) / block_seconds).cast("long"))
    touched = F.sequence(first, own)
    placed = (
        members.withColumn("own", own)
        .withColumn("block", F.explode(touched))
        .withColumn("halo", F.col("own") != F.col("block"))
        .select(*ISLAND, "block", "halo", "pos", "start", "end")
    )
    links = stage(
        placed.groupBy(*ISLAND, "block").applyInPandas(
            _merge_links(max_chunk),
            f"rec_id {key}, island long, pos long, nxt long, start double, end double",
        )
    )
    taken = follow(links, ISLAND, longest, levels)
    walked = links.join(taken.select(*ISLAND, "pos"), [*ISLAND, "pos"], "left_semi").select(
        "rec_id", "start", "end"
    )
    return whole.unionByName(walked.where(F.col("end") > F.col("start")))


def plan_spans(frames: DataFrame, recordings: DataFrame, s: SegmentationSettings) -> DataFrame:
    """The whole plan in seconds: runs, cuts, short-run filter, padding, merge."""
    seen = Observation()
    length = F.col("run_end") - F.col("run_start")
    runs = stage(speech_runs(frames, recordings, s).observe(seen, F.max(length).alias("longest")))
    cut = split_runs(runs, frames, recordings, s, longest=seen.get["longest"] or 0)
    return _merge_marked(_padded(stage(runs_to_spans(cut, recordings, s)), s), s)


def quantise(
    spans: DataFrame, recordings: DataFrame, rate: int, s: SegmentationSettings
) -> DataFrame:
    """Spans in whole samples with a chunk index from 0; rounding is half to even."""
    longest = int(s.max_chunk_seconds * rate // 1)
    total = F.rint(F.col("total_seconds") * rate).cast("long")
    start = F.rint(F.col("start") * rate).cast("long")
    sampled = (
        spans.join(recordings.select("rec_id", "total_seconds"), "rec_id")
        .select("rec_id", start.alias("start_sample"), F.rint(F.col("end") * rate).cast("long").alias("e"), total.alias("t"))
        .select(
            "rec_id",
            "start_sample",
            F.least(F.col("e"), F.col("start_sample") + longest, F.col("t")).alias("end_sample"),
        )
        .where(F.col("end_sample") > F.col("start_sample"))
    )
    return numbered(
        sampled,
        ["rec_id"],
        ["start_sample"],
        F.floor(F.col("start_sample") / (s.block_frames * 512)).cast("long"),
        "chunk_idx",
    ).select("rec_id", "chunk_idx", "start_sample", "end_sample")


def fixed_chunks(recordings: DataFrame, rate: int, max_chunk_seconds: float) -> DataFrame:
    """Chunks of equal length when no detector is used."""
    longest = int(max_chunk_seconds * rate // 1)
    total = F.rint(F.col("total_seconds") * rate).cast("long")
    return (
        recordings.select("rec_id", total.alias("total"))
        .where(F.col("total") > 0)
        .select(
            "rec_id",
            "total",
            F.posexplode(
                F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(longest).cast("long"))
            ).alias("chunk_idx", "start_sample"),
        )
        .select(
            "rec_id",
            F.col("chunk_idx").cast("long").alias("chunk_idx"),
            "start_sample",
            F.least(F.col("start_sample") + longest, F.col("total")).alias("end_sample"),
        )
    )


def prepared_profile(chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per recording: chunk count, shortest, mean and longest chunk, speech seconds and share."""
    length = F.col("end") - F.col("start")
    measured = chunks.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.min(length).alias("min_seconds"),
        F.avg(length).alias("avg_seconds"),
        F.max(length).alias("max_seconds"),
        F.sum(length).alias("speech_seconds"),
    )
    return recordings.select("rec_id", "total_seconds").join(measured, "rec_id", "left").select(
        "rec_id",
        "total_seconds",
        F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"),
        "min_seconds",
        "avg_seconds",
        "max_seconds",
        F.coalesce("speech_seconds", F.lit(0.0)).alias("speech_seconds"),
        F.when(
            F.col("total_seconds") > 0,
            100.0 * F.coalesce("speech_seconds", F.lit(0.0)) / F.col("total_seconds"),
        )
        .otherwise(0.0)
        .alias("speech_percent"),
    )
