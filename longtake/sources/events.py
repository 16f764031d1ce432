"""Event logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT_LINE
from .growing import read_growing


def _no_object() -> str:
    """Pattern of lines that begin with something else than an object, or whose first object never closes.

    All quantifiers are possessive: a line is read in one pass, and long ones do not fill the stack.
    An object nested deeper than the pattern follows counts as open; its ``}`` then fails the match.
    """
    inside = r'"[^"\\]*+(?:\\.[^"\\]*+)*+'
    items = rf'[^"{{}}]++|{inside}"'
    for _ in range(3):
        items = rf'[^"{{}}]++|{inside}"|\{{(?:{items})*+\}}'
    return rf'(?s)\A(?:\s*+[^\s{{\uFEFF]|[^"{{}}]*+(?:\{{(?:{items})*+)*+(?:{inside}\\?+)?+\z)'


NO_OBJECT = _no_object()


def may_parse(line: Column) -> Column:
    """False for text that is no object and for lines cut short, which have no type; all others are left to the parser.

    A line the parser refuses costs it two exceptions, far more than a good line. Most whole lines are known by their end.
    """
    return line.endswith("}") | ~line.rlike(NO_OBJECT)


def parse_events(lines: DataFrame, type_prefix: str | None = None) -> DataFrame:
    """Events of ``lines(value)``; lines that do not parse or have no string type are dropped."""
    body = F.from_json("value", EVENT_LINE, {"mode": "PERMISSIVE"})
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.type", "variant"))
    whole = F.when(may_parse(F.col("value")), kind == "STRING")
    events = lines.where(whole).select(body.alias("e")).select("e.*")
    events = events.withColumn("ts", F.try_to_timestamp("ts"))
    if type_prefix is not None:
        events = events.where(F.col("type").startswith(type_prefix))
    return events


def read_events(
    spark: SparkSession,
    path: str,
    type_prefix: str | None = None,
    *,
    stream: bool = False,
    files_per_trigger: int | None = None,
    growing: bool = False,
) -> DataFrame:
    """Read event logs as a table or a stream.

    Files of a plain stream are taken once, so writers should publish them atomically. With
    ``growing`` their writers may append: lines follow as they are finished.
    """
    if not stream:
        return parse_events(spark.read.text(path), type_prefix)
    if growing:
        return parse_events(read_growing(spark, path), type_prefix)
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_events(reader.text(path), type_prefix)


def event_lines(events: DataFrame) -> DataFrame:
    """The inverse: one JSON line per event, numbers that are not finite as null."""
    fixed = {"schema_version", "seq", "ts", "elapsed_s", "run_id", "job_id", "type"}
    kept = [c for c in events.columns if c in fixed]
    data = F.parse_json("data").alias("data")
    return events.select(F.to_json(F.struct(*kept, data)).alias("value"))
