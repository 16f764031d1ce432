"""Series over samples and event sequences: rates, histories, gaps, roll-ups, stalls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import first_per_key, neighbours, running
from ..schemas import RESOURCE_KEYS

SEQ_BLOCK = 1 << 16
STALL_SECONDS = 45
HISTORY = 60


def counter_rate(samples: DataFrame, keys: Sequence[str], order: str, block: Column) -> DataFrame:
    """Busy share in percent between neighbouring counter readings; null on the first."""
    seen = neighbours(
        samples, keys, [order], block, before={"prev_idle": F.col("idle"), "prev_total": F.col("total")}
    )
    d_total, d_idle = F.col("total") - F.col("prev_total"), F.col("idle") - F.col("prev_idle")
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (1 - d_idle / d_total)))
    return seen.withColumn("cpu_percent", F.when(d_total > 0, percent)).drop("prev_idle", "prev_total")


def history(samples: DataFrame, keys: Sequence[str], order: str, metrics: Sequence[str], n: int = HISTORY) -> DataFrame:
    """The last ``n`` known values of every metric, one row each."""
    long = samples.select(
        *keys,
        order,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        ).alias("m"),
    ).select(*keys, order, "m.metric", "m.value")
    known = long.where(F.col("value").isNotNull())
    return first_per_key(known, [*keys, "metric"], [F.desc(order)], n)


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Events whose number does not follow the one before: repeated, missing, or a bad start."""
    block = F.floor(F.col("seq") / SEQ_BLOCK)
    numbered = neighbours(
        events.select("run_id", "seq", "ts"), ["run_id"], ["seq", "ts"], block, before={"prev": F.col("seq")}
    )
    prev = F.coalesce("prev", F.lit(0))
    problem = F.when(F.col("seq") == prev, "repeated").when(F.col("seq") > prev + 1, "missing before")
    return numbered.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        "run_id", "seq", "problem", (F.col("seq") - prev - 1).alias("missing")
    )


def audit_names(attempts: DataFrame) -> DataFrame:
    """A distinct file name for every answer of a (chunk, part, temperature), oldest first.

    Attempts of one chunk are a bounded group: the ladder has few rungs.
    """
    from pyspark.sql import Window

    same = Window.partitionBy("job_id", "chunk_idx", "part", "temperature").orderBy("attempt_no")
    k = F.row_number().over(same)
    base = F.format_string(
        "%05d%s_t%03d", "chunk_idx", "part", F.rint(F.col("temperature") * 100).cast("long")
    )
    return attempts.select(
        "job_id",
        "chunk_idx",
        "part",
        "attempt_no",
        F.concat(base, F.when(k > 1, F.concat(F.lit("_r"), k.cast("string"))).otherwise(""), F.lit(".json")).alias("file_name"),
    )


def resource_rollup(
    samples: DataFrame, every: str, metrics: Sequence[str] = RESOURCE_KEYS, *, interval: float = 1.0
) -> DataFrame:
    """Latest known, mean and largest value of each metric per tumbling window.

    ``samples(run_id, ts, sampler, read_ts, <metrics>)``. A sampler that reports nothing for a
    metric does not overwrite it; readings too old for their sample are ignored. Works on a
    stream as well, where the caller sets the watermark.
    """
    fresh = F.unix_micros("ts") - F.unix_micros("read_ts") <= int(max(5.0, 5 * interval) * 1e6)
    gpu = F.col("sampler").contains("nvidia")
    known = F.lit(False)
    for m in metrics:
        known = known | F.col(m).isNotNull()
    stamp = lambda when: F.when(when, F.struct("ts", "sampler"))
    values = []
    for m in metrics:
        value = F.col(m)
        values += [
            F.max_by(value, stamp(value.isNotNull())).alias(f"{m}_last"),
            F.avg(value).alias(f"{m}_avg"),
            F.max(value).alias(f"{m}_max"),
        ]
    return (
        samples.where(fresh)
        .groupBy("run_id", F.window("ts", every).alias("w"))
        .agg(
            *values,
            F.max_by("sampler", stamp(gpu & known)).alias("gpu_source"),
            F.max_by("sampler", stamp(~gpu & known)).alias("host_source"),
        )
        .withColumn("window_start", F.col("w.start"))
        .drop("w")
    )


def stalls(events: DataFrame, gap_seconds: int = STALL_SECONDS) -> DataFrame:
    """Quiet stretches of a running run; resource samples do not count as activity."""
    active = events.where(F.col("type") != "resource.sample").select("run_id", "seq", "ts", "type")
    seen = neighbours(
        active, ["run_id"], ["seq"], F.floor(F.col("seq") / SEQ_BLOCK), before={"idle_from": F.col("ts"), "before_type": F.col("type")}
    )
    idle = (F.unix_micros("ts") - F.unix_micros("idle_from")) / 1e6
    return (
        seen.withColumn("idle_seconds", idle)
        .where((F.col("idle_seconds") >= gap_seconds) & (F.col("before_type") != "run.finished"))
        .select("run_id", "seq", "idle_from", F.col("ts").alias("idle_until"), "idle_seconds")
    )


def activity_sessions(events: DataFrame, gap_seconds: int = STALL_SECONDS) -> DataFrame:
    """Stretches of a run without a stall, in order of its events; no run lies in one task."""
    active = events.where(F.col("type") != "resource.sample").select("run_id", "seq", "ts")
    block = F.floor(F.col("seq") / SEQ_BLOCK)
    seen = neighbours(active, ["run_id"], ["seq"], block, before={"idle_from": F.col("ts")})
    idle = (F.unix_micros("ts") - F.unix_micros("idle_from")) / 1e6
    opens = F.when(idle.isNull() | (idle >= gap_seconds), 1).otherwise(0).cast("long")
    named = running(seen, ["run_id"], ["seq"], block, {"session": ("sum", opens)})
    return named.groupBy("run_id", "session").agg(
        F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events")
    )


# --- telemetry lines ------------------------------------------------------------------------


def _field(parts: Column, i: int) -> Column:
    text = F.trim(F.get(parts, i))
    number = F.expr(f"try_cast(trim(get(split(line, ','), {i})) as double)")
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite & ~text.startswith("["), number)


def parse_gpu_lines(lines: DataFrame) -> DataFrame:
    """``lines(…, line)`` with the fields of a GPU CSV line; fewer than six drop the line."""
    parts = F.split("line", ",")
    fields = ["gpu_index", "gpu_util_percent", "gpu_mem_used_mb", "gpu_mem_total_mb", "gpu_power_w", "gpu_temp_c", "gpu_encoder_percent"]
    parsed = lines.where(F.size(parts) >= 6).withColumns({f: _field(parts, i) for i, f in enumerate(fields)})
    return parsed.where(F.col("gpu_index").isNotNull()).withColumn("gpu_index", F.col("gpu_index").cast("long"))


def parse_cpu_counters(lines: DataFrame) -> DataFrame:
    """Idle and total jiffies of the ``cpu`` line in ``text``; other text drops the row."""
    first = F.regexp_extract("text", r"(?m)^cpu ([^\n]*)", 1)
    values = F.transform(F.filter(F.split(first, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("long"))
    parsed = lines.withColumn("__v", values).where(
        (F.size("__v") >= 4) & ~F.exists("__v", lambda x: x.isNull())
    )
    v = F.col("__v")
    return parsed.withColumns(
        {
            "idle": v[3] + F.coalesce(F.get(v, 4), F.lit(0)),
            "total": F.aggregate(F.slice(v, 1, 8), F.lit(0).cast("long"), lambda a, x: a + x),
        }
    ).drop("__v")


def parse_memory(lines: DataFrame) -> DataFrame:
    """Used and total memory in MB from ``text``."""
    kb = lambda key: F.expr(f"try_cast(nullif(regexp_extract(text, '(?m)^{key}:\\\\s*(\\\\d+)', 1), '') as long)")
    total = kb("MemTotal")
    rest = F.coalesce(kb("MemFree"), F.lit(0)) + F.coalesce(kb("Buffers"), F.lit(0)) + F.coalesce(kb("Cached"), F.lit(0))
    free = F.coalesce(kb("MemAvailable"), rest)
    return lines.withColumns(
        {
            "ram_used_mb": (total - free) / 1024,
            "ram_total_mb": total / 1024,
            "process_rss_mb": kb("VmRSS") / 1024,
        }
    )
