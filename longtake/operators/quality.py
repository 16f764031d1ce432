"""Whether a model's answer can be used: format, repetition, prompt echo, language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.columns import folded_words, let
from ..functions.languages import COLLATION, alias_table

MIN_JUDGED_CHARS = 40
ECHO_WORDS = 6
# The tagged answer form.
TAGGED = r"(?is)^\s*language\s+([^<]*?)\s*<asr_text>(.*)$"
TAGGED_NONE = r"(?i)^\s*language\s+none\s*(?:<asr_text>\s*)?$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_parts(parts: Column) -> Column:
    """Content given as parts: the text ones, joined."""
    chosen = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) == "text")
    return F.concat_ws("", F.transform(chosen, lambda p: p["text"]))


def normalise_responses(df: DataFrame, forced: Column | None = None) -> DataFrame:
    """Add ``text``, ``detected_language``, ``status`` and ``reason`` to raw answers.

    Needs ``content``, ``finish_reason`` and ``mode`` (``json``, ``plain`` or ``tagged``). Content
    may be given as parts, an array of structs with ``type`` and ``text``; that is never JSON. An
    answer cut at its limit is degenerate before anything is parsed. With a forced language a
    tagged answer must either carry no prefix or exactly that language.
    """
    content, mode = F.col("content"), F.col("mode")
    if isinstance(df.schema["content"].dataType, ArrayType):
        content = F.when(content.isNotNull() & (mode != "json"), text_parts(content))
    forced = F.lit(None).cast("string") if forced is None else forced
    parsed = F.try_parse_json(content)
    is_json = F.coalesce(F.schema_of_variant(parsed) == "OBJECT<transcript: STRING>", F.lit(False))
    json_text = strip(F.try_variant_get(parsed, "$.transcript", "string"))
    matched = content.rlike(TAGGED)
    language = strip(F.regexp_extract(content, TAGGED, 1))
    tail = strip(F.regexp_extract(content, TAGGED, 2))
    is_none = F.lower(language) == "none"
    tagged_text = (
        F.when(forced.isNotNull() & matched & (F.lower(language) == F.lower(forced)), tail)
        .when(forced.isNotNull() & ~matched, strip(content))
        .when(forced.isNotNull(), None)
        .when(matched & is_none & (tail != ""), None)
        .when(matched & is_none, "")
        .when(matched, tail)
        .when(content.rlike(TAGGED_NONE), "")
    )
    text = (
        F.when(mode == "json", F.when(is_json, json_text))
        .when(mode == "tagged", tagged_text)
        .otherwise(strip(content))
    )
    reason = (
        F.when(F.col("finish_reason").eqNullSafe("length"), "length")
        .when(F.col("content").isNull(), "no_content")
        .when(text.isNull(), "invalid")
    )
    detected = F.when(
        (mode == "tagged") & reason.isNull(),
        F.coalesce(forced, F.when(matched & ~is_none & (language != ""), language)),
    )
    return df.withColumns(
        {
            "text": F.when(reason.isNull(), text),
            "detected_language": detected,
            "status": F.when(reason.isNotNull(), "degenerate").when(text == "", "no_speech").otherwise("ok"),
            "reason": reason,
        }
    )


@pandas_udf(DoubleType())
def compression_ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Raw to compressed bytes; null below the judged length. There is no JVM function for it."""
    for texts in batches:
        yield pd.Series(
            [
                None
                if t is None or len(t) < MIN_JUDGED_CHARS
                else len(raw := t.encode()) / len(zlib.compress(raw))
                for t in texts
            ],
            dtype="float64",
        )


def repetition_gate(df: DataFrame, threshold: float = 2.4) -> DataFrame:
    """Mark texts that compress too well to be speech."""
    return df.withColumn("compression_ratio", compression_ratio("text")).withColumn(
        "loops", F.coalesce(F.col("compression_ratio") > threshold, F.lit(False))
    )


def word_runs(text: Column, n: int, hashed: bool = False) -> Column:
    """Distinct runs of ``n`` consecutive folded words (or their hashes); null for shorter texts."""

    def runs(words: Column) -> Column:
        def run(i: Column) -> Column:
            # The hash takes the words as they are, without building the joined text.
            own = [F.get(words, i + k) for k in range(n)]
            return F.xxhash64(*own) if hashed else F.concat_ws(" ", *own)

        return F.when(
            F.size(words) >= n,
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - n), run)),
        )

    return let(folded_words(text), runs)


def find_echoes(texts: DataFrame, prompts: DataFrame, key: str, n: int = ECHO_WORDS) -> DataFrame:
    """Keys of texts that contain any run of ``n`` consecutive words of any prompt.

    Semi joins throughout: a run shared by many prompts or repeated in many texts never
    multiplies rows. First only 8-byte hashes travel; texts that hit are then compared word for
    word, so the answer is exact.
    """
    wanted = prompts.select(F.explode(word_runs(F.col("text"), n)).alias("run")).distinct()
    hashes = prompts.select(F.explode(word_runs(F.col("text"), n, hashed=True)).alias("h")).distinct()
    candidates = (
        texts.select(key, F.explode(word_runs(F.col("text"), n, hashed=True)).alias("h"))
        .join(hashes, "h", "left_semi")
        .select(key)
        .distinct()
    )
    return (
        texts.join(candidates, key, "left_semi")
        .select(key, F.explode(word_runs(F.col("text"), n)).alias("run"))
        .join(wanted, "run", "left_semi")
        .select(key)
        .distinct()
    )


def echoes_own_prompt(df: DataFrame, n: int = ECHO_WORDS) -> DataFrame:
    """Per answer: whether its text repeats a run of its own prompt. Nothing is shuffled."""
    shared = F.arrays_overlap(word_runs(F.col("text"), n), word_runs(F.col("prompt"), n))
    return df.withColumn("prompt_echo", F.coalesce(shared, F.lit(False)))


def normalise_language(df: DataFrame, column: str, supported: list[str] | None = None) -> DataFrame:
    """Add ``code`` for what was typed: exact name, else the part before ``-``, else before ``_``.

    Case, accents and outer spaces are ignored by the collation. The alias table has a fixed
    number of rows, so it is broadcast.
    """
    aliases = F.broadcast(alias_table(df.sparkSession))
    typed = F.trim(column)
    out = df
    for i, part in enumerate((typed, F.split_part(typed, F.lit("-"), F.lit(1)), F.split_part(typed, F.lit("_"), F.lit(1)))):
        names = aliases.select(F.col("alias").alias(f"__a{i}"), F.col("code").alias(f"__c{i}"))
        out = out.join(names, F.collate(part, COLLATION) == F.col(f"__a{i}"), "left").drop(f"__a{i}")
    code = F.coalesce("__c0", "__c1", "__c2")
    if supported is not None:
        code = F.when(code.isin(supported), code)
    return out.withColumn("code", code).drop("__c0", "__c1", "__c2")
