"""Exact percentiles per key without gathering a key's values in one task.

Equal values are counted first, so a value that holds most of a key is one row. The counts are
summed along the values in blocks (``ordered.running``) and the wanted ranks are read off. Block
edges come from a sketch of the distinct values; they balance the tasks and change no result.
Keys with few values are one block and need none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

BLOCKS = 32
SKETCH = 1_000
SALTS = 32
WHOLE = 4096  # values of a key that make one block


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    wanted: Mapping[str, tuple[float, str]],
) -> DataFrame:
    """One row per key: ``n`` and a column per wanted ``name -> (fraction, kind)``.

    ``kind`` is ``nearest`` (``sorted[max(0, ceil(f*n)-1)]``) or ``linear``
    (interpolated at ``f*(n-1)``). Nulls are left out.
    """
    known = F.col("__v").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    values = df.select(*keys, value.cast("double").alias("__v")).where(known)
    counted = values.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    edges = [i / BLOCKS for i in range(1, BLOCKS)]
    bounds = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__values"), F.percentile_approx("__v", edges, SKETCH).alias("__edges")
    )
    # The few bounds are repeated per salt, so the values of one key meet them in many tasks.
    repeated = bounds.where(F.col("__values") > WHOLE).select(
        *keys, "__edges", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt")
    )
    salted = counted.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS).cast("long")))
    block = F.when(F.col("__edges").isNull(), 0).otherwise(F.size(F.filter("__edges", lambda e: e < F.col("__v"))))
    placed = salted.join(repeated, [*keys, "__salt"], "left").select(*keys, "__v", "__c", block.alias("__block"))
    ranked = running(
        placed, keys, ["__v"], F.col("__block"), {"__upto": ("sum", F.col("__c")), "__n": ("total", F.col("__c"))}
    )
    n, upto, c = F.col("__n"), F.col("__upto"), F.col("__c")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < upto) & (rank >= upto - c), F.col("__v")))

    picks, combined = [], []
    for name, (fraction, kind) in wanted.items():
        if kind == "nearest":
            picks.append(at(F.greatest(F.lit(0), F.ceil(F.lit(fraction) * n).cast("long") - 1)).alias(name))
            combined.append(F.col(name))
        else:
            position = F.lit(fraction) * (n - 1)
            picks += [at(F.floor(position)).alias(f"__low_{name}"), at(F.ceil(position)).alias(f"__high_{name}")]
            low, high, share = F.col(f"__low_{name}"), F.col(f"__high_{name}"), F.lit(fraction) * (F.col("n") - 1)
            combined.append((low + (high - low) * (share - F.floor(share))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("__n").alias("n"), *picks).select(*keys, "n", *combined)
