"""Following next-pointers along a key, block by block.

A greedy algorithm (cut here, then look again from there) visits a chain of positions, each
known only from the one before. Where a key fits one block the chain is walked in one group.
Longer keys are cut into blocks: every possible entry of a block is mapped to the position where
the chain leaves it, those maps form a much shorter chain, and the blocks are then walked from
their true entries in parallel. No group ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

END = -1
LEVELS = (1 << 16, 1 << 28)


def _jump(pos: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each next position inside the block, and whether it lies inside."""
    at = np.searchsorted(pos, nxt)
    inside = (nxt != END) & (at < len(pos))
    inside[inside] = pos[at[inside]] == nxt[inside]
    return at, inside


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos", ignore_index=True)
    pos, leave = pdf["pos"].to_numpy(), pdf["nxt"].to_numpy().copy()
    at, inside = _jump(pos, leave)
    while inside.any():
        leave[inside] = leave[at[inside]]
        at, inside = _jump(pos, leave)
    return pdf.assign(nxt=leave)[pdf["entry"]].drop(columns=["entry", "block"])


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos", ignore_index=True)
    pos, nxt = pdf["pos"].to_numpy(), pdf["nxt"].to_numpy()
    at, inside = _jump(pos, nxt)
    reached = pdf["entry"].to_numpy().copy()
    here = int(np.flatnonzero(reached)[0]) if reached.any() else -1
    while here >= 0 and inside[here]:
        here = int(at[here])
        reached[here] = True
    return pdf[reached].drop(columns=["entry", "block"])


def follow(
    links: DataFrame, keys: Sequence[str], longest: int, levels: Sequence[int] = LEVELS
) -> DataFrame:
    """Rows of ``links(keys…, pos, nxt)`` reached from position 0 of each key.

    ``nxt`` is larger than ``pos`` and names a row of the same key, or ``END``. ``longest`` is an
    upper bound of ``pos``; it decides how many levels of blocks are needed. ``links`` is read
    several times and should be a written table.
    """
    keys = list(keys)
    shape = links.select(*keys, "pos", "nxt")
    if not levels or longest < levels[0]:
        tagged = shape.withColumn("block", F.lit(0).cast("long")).withColumn("entry", F.col("pos") == 0)
        return tagged.groupBy(*keys).applyInPandas(_walk, shape.schema)
    size = levels[0]
    tagged = shape.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    entered = (
        tagged.where((F.col("nxt") != END) & (F.floor(F.col("nxt") / size) > F.col("block")))
        .select(*keys, F.col("nxt").alias("pos"))
        .distinct()
        .withColumn("entry", F.lit(True))
    )
    columns = [*keys, "pos", "nxt", "block", "entry"]
    marked = tagged.join(entered, [*keys, "pos"], "left").withColumn(
        "entry", F.coalesce("entry", F.col("pos") == 0)
    )
    hops = marked.select(*columns).groupBy(*keys, "block").applyInPandas(_exits, shape.schema)
    true_entries = follow(stage(hops), keys, longest, levels[1:]).select(
        *keys, "pos", F.lit(True).alias("entry")
    )
    opened = tagged.join(true_entries, [*keys, "pos"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(False))
    )
    return opened.select(*columns).groupBy(*keys, "block").applyInPandas(_walk, shape.schema)
