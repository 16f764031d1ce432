"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import partitions

LARGEST_FOR_NUMPY = 10**9


def _taken(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw. Beyond numpy's range: inversion around the mode, 16 deviations wide."""
    if good + bad < LARGEST_FOR_NUMPY:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    reach = int(16 * math.sqrt(n * good / (good + bad) * bad / (good + bad)) + 16)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratio = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(int(np.searchsorted(p, rng.random() * p[-1], side="right")), len(k) - 1)])


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard, as a uniform shuffle would deal them.

    Shards get sizes at most one apart. Each partition draws without replacement from the places
    that are left, one shard after the other.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    free = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in counts:
        row, places = [], sum(free)
        for j in range(shards):
            places -= free[j]
            got = n if j == shards - 1 else _taken(rng, free[j], places, n)
            row.append(got)
            n -= got
        free = [f - g for f, g in zip(free, row, strict=True)]
        matrix.append(row)
    return matrix


def shard(docs: DataFrame, shards: int = 24, *, seed: int = 7, key: str = "doc_id", rows_per_part: int = 20_000) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and ``slot`` (from 0 without gaps inside its shard).

    Rows are dealt to parts by a hash of their key and text, so parts do not depend on how the
    input is split and a lost task finds the same ones again. The matrix needs only the number of
    rows per part (as many numbers on the driver as there are parts). Inside a part a second hash
    permutes the rows and the matrix cuts that order into shards; inside a shard a third hash
    permutes again, over blocks so that no task holds a whole shard. Equal hashes are told apart by
    the row's order in its task, null keys are hashed with their text, repeated rows get places of
    their own, and an empty table gives no rows. Columns named shard or slot are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    total = docs.count()
    parts = max(partitions(spark), -(-total // rows_per_part))
    body = F.xxhash64(F.col(key), *[F.col(c) for c in docs.columns if c == "text"])
    hashed = docs.withColumn("__h", body)
    part = F.pmod(F.xxhash64(F.lit(seed), F.lit("part"), "__h"), F.lit(parts)).cast("int")
    counts = dict(hashed.groupBy(part.alias("part")).count().collect())
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = spark.createDataFrame(
        [(p, np.cumsum(row).tolist()) for p, row in enumerate(matrix)], "__part int, __ends array<long>"
    )
    blocks = max(1, -(-total // (shards * rows_per_part)))
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "__h"), "__h")
    placed = (
        hashed.withColumn("__part", part)
        .repartition(parts, "__part")
        .withColumn("__rank", F.row_number().over(local) - 1)
        .join(stage(ends), "__part")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))))
        .drop("__ends")
        .withColumn("__second", F.xxhash64(F.lit(seed), F.lit("second"), "__h", "__rank", "__part"))
        .withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "__second"), F.lit(blocks)).cast("int"))
    )
    if blocks > 1:  # places of the blocks of each shard, from their sizes alone
        sizes = stage(placed.groupBy("shard", "__block").agg(F.count("*").alias("__n")))
        earlier = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
        placed = placed.join(offsets, ["shard", "__block"])
    else:
        placed = placed.withColumn("__offset", F.lit(0))
    again = Window.partitionBy("shard", "__block").orderBy("__second", "__h", "__part", "__rank")
    return (
        placed.withColumn("slot", (F.row_number().over(again) - 1 + F.col("__offset")).cast("long"))
        .drop("__h", "__part", "__rank", "__second", "__block", "__offset")
    )
