"""Pieces that several of the training-data operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, stage

# White space as the contracts count it: ASCII only, so that str.split() would cut too often.
# ``bytes.split()`` cuts at exactly these six characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


BATCH_ROWS = 500  # of whole texts that are in a Python worker at once
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers and keeps batches small enough for long texts."""
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bare(text: str | None) -> list[bytes]:
    """The same words of one text inside a Python worker, as UTF-8."""
    return text.encode().split() if text else []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exclusive_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds one column per entry of ``sums``: the total of its value over all rows before this one.

    Rows are range partitioned by ``order`` and written; only one row of totals per partition is
    summed in a single task, so the number of rows there is the number of shuffle partitions.
    ``order`` should be unique; rows equal in it are summed in any order.
    """
    part = "__part"
    placed = stage(
        df.withColumns({f"__value_{k}": v for k, v in sums.items()})
        .repartitionByRange(partitions(df.sparkSession), *order)
        .withColumn(part, F.spark_partition_id())
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(*[F.sum(f"__value_{k}").alias(f"__total_{k}") for k in sums])
        .select(part, *[F.sum(f"__total_{k}").over(before).alias(f"__before_{k}") for k in sums])
    )
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumns({f"__inside_{k}": F.sum(f"__value_{k}").over(inside) for k in sums})
        .join(F.broadcast(offsets), part)  # one row per partition
        .withColumns({k: F.coalesce(f"__inside_{k}", F.lit(0)) + F.coalesce(f"__before_{k}", F.lit(0)) for k in sums})
        .drop(part, *[f"{p}{k}" for k in sums for p in ("__value_", "__inside_", "__before_")])
    )
