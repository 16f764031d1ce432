"""Quality rules whose limits come from quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACES, text_of, words

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Measures a fence is set for, in thousandths (or hundredths of a character); large is bad.
MEASURES = {
    "symbols": "if(word_chars > 0, n_symbols * 1000 div word_chars, 0)",
    "dup_lines": "if(n_lines > 0, n_dup_lines * 1000 div n_lines, 0)",
    "repeats": "if(n_words > 0, n_repeat_words * 1000 div n_words, 0)",
    "word_length": "if(n_words > 0, word_chars * 100 div n_words, 0)",
}


@dataclass(frozen=True)
class Fences:
    """A measure may reach its high quantile plus ``reach`` times the distance from the middle one, and a margin.

    Quantiles are in thousandths. Those of a language and source are drawn to those of the language,
    as if ``weight`` documents of the language were among them, and those of a language likewise to
    all documents, so limits move little with one document more. The margin is what a measure may
    exceed its quantiles by where most documents are the same.
    """

    middle: int = 500
    high: int = 850
    reach: int = 4
    weight: int = 100
    margin: tuple[tuple[str, int], ...] = (("symbols", 80), ("dup_lines", 350), ("repeats", 250), ("word_length", 150))


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts of every whole text; null text counts as empty.

    Windows of three words are sorted with their positions; equal neighbours are the repeated ones.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    start = docs.withColumns(
        {
            "__words": words(F.col("text")),
            "__lines": lines,
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    n = F.size("__words")
    three = F.arrays_zip(
        F.slice("__words", 1, F.greatest(n - 2, F.lit(0))).alias("a"),
        F.slice("__words", 2, F.greatest(n - 2, F.lit(0))).alias("b"),
        F.slice("__words", 3, F.greatest(n - 2, F.lit(0))).alias("c"),
    )
    windows = F.transform(three, lambda z: F.concat_ws(" ", z["a"], z["b"], z["c"]))
    start = start.withColumns(
        {
            "n_words": n.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": windows,
        }
    )
    placed = F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    size = F.size("__sorted")
    none = F.struct(F.lit(None).cast("string").alias("w"), F.lit(None).cast("int").alias("i"))
    neighbours = F.arrays_zip(
        F.col("__sorted").alias("me"),
        F.concat(F.array(none), F.slice("__sorted", 1, F.greatest(size - 1, F.lit(0)))).alias("before"),
        F.concat(F.slice("__sorted", 2, F.greatest(size - 1, F.lit(0))), F.array(none)).alias("after"),
    )
    again = F.filter(neighbours, lambda z: (z["me"]["w"] == z["before"]["w"]) | (z["me"]["w"] == z["after"]["w"]))
    covered = F.array_distinct(
        F.flatten(F.transform(again, lambda z: F.array(z["me"]["i"], z["me"]["i"] + 1, z["me"]["i"] + 2)))
    )
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return (
        start.withColumn("__sorted", F.when(some, placed))
        .withColumn("n_repeat_words", F.when(F.col("__sorted").isNull(), 0).otherwise(F.size(covered)).cast("long"))
        .drop("__words", "__lines", "__windows", "__sorted")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number: itself below 16, then eight per power of two.

    Counts per bucket are a quantile sketch: they merge by addition, do not depend on any order,
    and a quantile read from them is at most an eighth too low.
    """
    power = F.length(F.bin(value)) - 1
    step = F.call_function("shiftright", value, (power - 3).cast("int"))
    return F.when(value < 16, value).otherwise(F.call_function("shiftleft", step, (power - 3).cast("int")))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of every measure per language and source."""
    rows = counted.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(v).cast("long").alias("value")) for k, v in MEASURES.items()])).alias("m"),
    )
    return (
        rows.select("lang", "source", "m.measure", bucket(F.col("m.value")).alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _quantiles(sketch: DataFrame, keys: list[str], settings: Fences, prefix: str) -> DataFrame:
    """The two quantiles and the size of every merged sketch, and its keys, under names with ``prefix``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns(
        {"below": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)}
    )
    at = lambda q: F.min(F.when(F.col("below") * 1000 >= F.col("all") * q, F.col("bucket")))
    found = ranked.groupBy(*keys, "measure").agg(
        at(settings.middle).alias("middle"), at(settings.high).alias("high"), F.max("all").alias("size")
    )
    return found.select(*[F.col(c).alias(f"{prefix}{c}") for c in found.columns])


def fences(sketch: DataFrame, settings: Fences = Fences()) -> DataFrame:
    """One row per language and source with an upper limit for each measure."""
    own = _quantiles(sketch, ["lang", "source"], settings, "own_")
    lang = _quantiles(sketch, ["lang"], settings, "lang_")
    every = _quantiles(sketch, [], settings, "all_")
    joined = own.join(
        lang, F.col("own_lang").eqNullSafe(F.col("lang_lang")) & (F.col("own_measure") == F.col("lang_measure"))
    ).join(every, F.col("own_measure") == F.col("all_measure"))
    # Whole numbers, so that limits are the same wherever they are computed.
    drawn = "(own_size * own_{q} + {w} * ((lang_size * lang_{q} + {w} * all_{q}) div (lang_size + {w}))) div (own_size + {w})"
    middle, high = (F.expr(drawn.format(q=q, w=int(settings.weight))) for q in ("middle", "high"))
    margin = F.create_map(*[F.lit(x) for pair in settings.margin for x in pair])
    limit = high + settings.reach * (high - middle) + margin[F.col("own_measure")]
    return joined.groupBy(F.col("own_lang").alias("lang"), F.col("own_source").alias("source")).agg(
        *[F.max(F.when(F.col("own_measure") == k, limit)).alias(f"limit_{k}") for k in MEASURES]
    )


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept to counted documents; ``limits`` come from ``fences``."""
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    within = F.lit(True)
    for name, measure in MEASURES.items():
        within = within & (F.expr(measure) <= F.col(f"limit_{name}"))
    joined = counted.join(
        limits,
        F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")),
        "left",
    ).drop("__lang", "__source")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & F.coalesce(within, F.lit(True))})


def rated(docs: DataFrame, settings: Fences = Fences()) -> DataFrame:
    """(doc_id, lang, source, counts, limits, base_failed, kept) of every document.

    Null language and null source are groups of their own. Rows are never merged, so repeated rows
    give repeated results. Empty and null texts have no words and fail the base rule. Other columns are
    ignored; an empty table gives no rows. Documents are
    counted once and written narrow, without their text.
    """
    counted = stage(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(counted, stage(fences(sketches(counted), settings)))


def keep(docs: DataFrame, settings: Fences = Fences()) -> DataFrame:
    """The documents that pass, with the columns they came with.

    Counts are computed a second time for the filter: that costs less than moving all texts
    through a join with the first ones. Columns of ``docs`` called like a count are set aside.
    An empty table gives none.
    """
    limits = stage(fences(sketches(stage(with_counts(docs.select("lang", "source", "text")).drop("text"))), settings))
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    counted = with_counts(docs.select("lang", "source", "text", body))
    # A column that is not deterministic keeps the filter above the counts. Pushed below them it
    # would hold every expression they are made of, again for each place where one is used.
    counted = counted.withColumn("__at", F.monotonically_increasing_id())
    return judge(counted, limits).where("kept and __at >= 0").select("__row.*")
