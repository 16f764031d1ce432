"""Column expressions: guards, classifications, labels and formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Bind a value that ``then`` uses more than once, so it is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def finite(value: Column) -> Column:
    """The number, or null when it is not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < INF), value)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as the formats and sample counts need it."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale if digits else F.rint(value)


def classify_level(line: Column) -> Column:
    """Severity of a status line."""
    error = line.startswith("Failed ") | line.contains("FAILED") | line.contains("-> job fails")
    fallback = line.startswith("Backend:") & line.contains("(fallback from")
    warning = (
        line.startswith("Could not")
        | line.startswith("Incomplete")
        | (line.startswith("Skipped") & ~line.contains("already completed"))
    )
    return F.when(error, "error").when(fallback | warning, "warning").otherwise("info")


def degenerate_reason(finish_reason: Column, error: Column) -> Column:
    """Short reason of a degenerate answer that carries no text; the first match wins."""
    message = F.coalesce(error, F.lit(""))
    return (
        F.when(finish_reason.eqNullSafe("length"), "length")
        .when(message.contains("repetition loop"), "loop")
        .when(message.contains("instruction prompt"), "prompt_echo")
        .otherwise("invalid")
    )


def covers(delivered: Column, expected: Column) -> Column:
    """Whether a delivered duration matches the expected one."""
    return F.abs(delivered - expected) <= F.greatest(F.lit(1.0), expected * 0.001)


def short_message(text: Column, limit: int = 200) -> Column:
    """Whitespace collapsed, cut with dots when too long."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit("..."))
    )


def request_budget(
    start: Column, end: Column, max_tokens: int, min_tokens: float, tokens_per_second: float
) -> Column:
    """Token limit of one call; a short chunk cannot need the full budget."""
    seconds = F.greatest(F.lit(0.0), end - start)
    wanted = F.ceil(F.lit(float(min_tokens)) + F.lit(float(tokens_per_second)) * seconds)
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(max_tokens).cast("long"), wanted.cast("long")))


def number_label(value: Column) -> Column:
    """A number inside a label: whole numbers plain, else up to three decimals with ``p``."""
    fixed = F.regexp_replace(F.format_string("%.3f", value), "0+$", "")
    return F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(
        F.regexp_replace(fixed, r"\.", "p")
    )


def scope_label(max_duration: Column, start_seconds: Column) -> Column:
    """``full``, ``unknown``, ``first…s`` or ``from…s-rest`` / ``from…s-first…s``."""
    bound = (
        F.when(max_duration.isNull(), "full")
        .when(F.isnan(max_duration) | (max_duration == INF) | (max_duration <= 0), "unknown")
        .otherwise(F.concat(F.lit("first"), number_label(max_duration), F.lit("s")))
    )
    tail = F.when(max_duration.isNull(), "rest").otherwise(bound)
    return F.when(
        F.coalesce(start_seconds, F.lit(0.0)) != 0,
        F.concat(F.lit("from"), number_label(start_seconds), F.lit("s-"), tail),
    ).otherwise(bound)


def scope_struct(max_duration: Column, start_seconds: Column) -> Column:
    begin = F.coalesce(start_seconds, F.lit(0.0))
    return F.struct(
        F.when(max_duration.isNull() & (begin == 0), "full").otherwise("bounded").alias("kind"),
        F.when(begin != 0, begin).alias("start_seconds"),
        max_duration.alias("max_duration_seconds"),
        scope_label(max_duration, start_seconds).alias("label"),
    )


def duration_text(seconds: Column) -> Column:
    """``48 ms``, ``59.9 s``, ``1 min 01 s``, ``1 h 05 min 03 s``; ``n/a`` when unknown."""
    s = F.greatest(F.lit(0.0), seconds)
    whole = F.rint(s).cast("long")
    tenths = one_decimal(s)
    h, m, r = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    long_form = F.when(h > 0, F.format_string("%d h %02d min %02d s", h, m, r)).otherwise(
        F.format_string("%d min %02d s", m, r)
    )
    return (
        F.when(finite(seconds).isNull(), "n/a")
        .when(s < 0.1, F.concat(F.rint(s * 1000).cast("long").cast("string"), F.lit(" ms")))
        .when((_tenths(s) <= 599) & (s < 60), F.concat(tenths, F.lit(" s")))
        .otherwise(long_form)
    )


def _tenths(x: Column) -> Column:
    """Nearest whole number of tenths to the exact binary value, ties to even.

    ``x * 20`` is the sum of two exact products; its rounding error is recovered, so the
    comparison with the tie is exact too.
    """
    n = F.rint(x * 10)
    a, b = x * 16, x * 4
    s = a + b
    back = s - a
    error = (a - (s - back)) + (b - back)
    off = s - n * 2
    odd = F.abs(n % 2) == 1
    above = (off > 1) | ((off == 1) & ((error > 0) | ((error == 0) & odd)))
    below = (off < -1) | ((off == -1) & ((error < 0) | ((error == 0) & odd)))
    return F.when(above, n + 1).when(below, n - 1).otherwise(n).cast("long")


def one_decimal(x: Column) -> Column:
    """A number that is not negative, with one decimal."""
    n = _tenths(x)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def timing_text(seconds: Column) -> Column:
    """Human time followed by the exact seconds where they differ."""
    exact = F.concat(one_decimal(F.greatest(F.lit(0.0), seconds)), F.lit(" s"))

    def both(human: Column) -> Column:
        return F.when(
            human.contains("min"), F.concat(human, F.lit(" ("), exact, F.lit(")"))
        ).otherwise(human)

    return let(duration_text(seconds), both)


def folded_words(text: Column) -> Column:
    """Case-folded words of a text."""
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def clock(seconds: Column, separator: str) -> Column:
    """``HH:MM:SS`` and milliseconds, rounded half to even."""
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d",
        F.floor(ms / 3_600_000),
        F.floor(ms % 3_600_000 / 60_000),
        F.floor(ms % 60_000 / 1000),
        ms % 1000,
    )
