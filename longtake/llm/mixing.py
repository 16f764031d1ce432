"""Mixing sources to target weights: repetition rates per source, whole copies plus one drawn copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import exclusive_sums, words

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: int = 2) -> DataFrame:
    """From (source, source_size) the wanted size of each source.

    Sources in order of code points, null last, weigh ``weights`` in turn. They share ``budget``
    times all sizes; a source gets at most ``most`` times its own size and what it leaves is shared
    again by weight. In order of size per weight the sources at their limit come first, so one
    running sum finds the level at which all others meet.
    """
    sizes = exclusive_sums(stage(sizes), [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    each = F.array(*[F.lit(w) for w in weights])
    sizes = sizes.withColumns(
        {
            "weight": F.element_at(each, (F.col("rank") % len(weights) + 1).cast("int")),
            "limit": F.col("source_size") * most,
        }
    )
    per_weight = F.col("limit") / F.col("weight")
    order = [per_weight, F.col("source").asc_nulls_last()]
    placed = stage(exclusive_sums(sizes, order, {"limits_before": F.col("limit"), "weights_before": F.col("weight")}))
    total = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, weight = (total[0] or 0) * budget, total[1] or 0
    capped = (F.lit(wanted) - F.col("limits_before")) * F.col("weight") >= F.col("limit") * (
        F.lit(weight) - F.col("weights_before")
    )
    rest = placed.where(capped).agg(F.sum("limit"), F.sum("weight")).first()
    shared, open_weight = wanted - (rest[0] or 0), weight - (rest[1] or 0)
    level = F.lit(float(shared)) * F.col("weight") / F.lit(float(open_weight or 1))
    return placed.select(
        "source", "source_size", "weight", F.when(capped, F.col("limit").cast("double")).otherwise(level).alias("target")
    )


def draw(key: Column, seed: str) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_plan(
    docs: DataFrame, size: Column | None = None, *, seed: str = "mix", weights: Sequence[int] = WEIGHTS,
    budget: float = 1.5, most: int = 2,
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and the ``copies`` the mix takes.

    The rate of a source is target / source_size. Each document is taken floor(rate) times, and once
    more with the fraction as probability, drawn from a hash of its doc_id. So reruns agree, and
    rows that share a doc_id (or have none) share their draw. Null sources are one source. Null or
    empty text has size 0. Columns of ``docs`` that are called like an added one are replaced.
    """
    size = size if size is not None else F.size(words(F.col("text"))).cast("long")
    sizes = docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, budget, most)).select(
        F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target")]
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return (
        docs.withColumn("size", size)
        .join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
        .withColumns({"source_size": F.col("__source_size"), "target": F.col("__target")})
        .drop("__source", "__source_size", "__target")
        .withColumn("copies", whole + (draw(F.col("doc_id"), seed) < rate - whole).cast("long"))
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``mix_plan`` takes it.

    Columns called like one that the plan adds are set aside and come back as they were. An empty
    table gives none.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    plan = mix_plan(docs.select("doc_id", "source", "text", row), **settings).where("copies > 0")
    repeated = plan.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("__row.*")
