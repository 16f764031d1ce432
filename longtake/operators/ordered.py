"""Ordered computations that survive one key holding most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here every key is cut into
blocks along its order: a window runs inside each (key, block), one summary row per block is
combined across the blocks of a key, and the summary is joined back. The large side is shuffled
once, on its cell; only the summaries are ever ordered per key.

A cell is one struct of key and block, not two columns: rows that already lie together by key
alone would satisfy a window over both columns, and a hot key would stay in one task.

The summaries are merged with rows that lie sorted by cell already. They are never broadcast:
with many short keys there are nearly as many of them as rows, and the size Spark expects of them
goes by the compressed files below.

``block`` must grow with the order: rows of a later block come after all rows of an earlier one.
A column made by ``cell`` may be given instead, where a join before has used it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "__cell"

Spec = tuple[str, Column]


def cell(keys: Sequence[str], block: Column) -> Column:
    return F.struct(*[F.col(k).alias(k) for k in keys], block.alias("block"))


def _with_cell(df: DataFrame, keys: Sequence[str], block: Column | str) -> DataFrame:
    if isinstance(block, str):
        return df.withColumn(CELL, F.col(block))
    return df.withColumn(CELL, cell(keys, block))


def _keys_of_cell(keys: Sequence[str]) -> list[Column]:
    return [F.col(CELL).getField(k).alias(k) for k in keys]


def _fold(kind: str, value: Column) -> Column:
    if kind == "total":
        return F.sum(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _block_total(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return _fold(kind, value)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local + carried, local, carried)
    if kind == "last":
        return F.coalesce(local, carried)
    return {"max": F.greatest, "min": F.least}[kind](local, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    aggregates: Mapping[str, Spec],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates (``sum``, ``max``, ``min``, ``last`` non-null) up to each row.

    ``total`` is the sum over all rows of the key, before and after.
    """
    tagged = _with_cell(df, keys, block)
    inside = (
        Window.partitionBy(CELL)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    local = tagged.select(
        "*",
        *[_fold(kind, value).over(inside).alias(f"__l_{n}") for n, (kind, value) in aggregates.items() if kind != "total"],
    )
    position = F.struct(*order)
    totals = (
        tagged.groupBy(CELL)
        .agg(
            *[
                _block_total(kind, value, position).alias(f"__t_{n}")
                for n, (kind, value) in aggregates.items()
            ]
        )
        .select("*", *_keys_of_cell(keys))
    )
    earlier = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        CELL,
        *[
            _fold(kind, F.col(f"__t_{n}")).over(Window.partitionBy(*keys) if kind == "total" else earlier).alias(f"__c_{n}")
            for n, (kind, _) in aggregates.items()
        ],
    )
    return local.join(carry.hint("merge"), CELL, "left").select(
        *df.columns,
        *[
            (F.col(f"__c_{n}") if kind == "total" else _combine(kind, F.col(f"__l_{n}"), F.col(f"__c_{n}"))).alias(n)
            for n, (kind, _) in aggregates.items()
        ],
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    *,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add values of the previous (``before``) and next (``after``) row of the same key."""
    before, after = before or {}, after or {}
    tagged = _with_cell(df, keys, block)
    inside = Window.partitionBy(CELL).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CELL)
    position = F.struct(*order)
    local, edges, carried = [], [], []
    for tag, fields, shift, pick in (
        ("b", before, F.lag, F.max_by),
        ("a", after, F.lead, F.min_by),
    ):
        if not fields:
            continue
        packed = F.struct(*[value.alias(n) for n, value in fields.items()])
        local.append(shift(packed).over(inside).alias(f"__l{tag}"))
        edges.append(pick(packed, position).alias(f"__e{tag}"))
        carried.append(shift(f"__e{tag}").over(across).alias(f"__c{tag}"))
    near = tagged.select("*", *local)
    summed = tagged.groupBy(CELL).agg(*edges).select("*", *_keys_of_cell(keys))
    carry = summed.select(CELL, *carried)
    out = []
    for tag, fields in (("b", before), ("a", after)):
        out.extend(
            F.coalesce(F.col(f"__l{tag}"), F.col(f"__c{tag}")).getField(n).alias(n) for n in fields
        )
    return near.join(carry.hint("merge"), CELL, "left").select(*df.columns, *out)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    name: str,
    *,
    first: int = 0,
) -> DataFrame:
    """Add the position of each row within its key, counted from ``first``."""
    counted = running(df, keys, order, block, {name: ("sum", F.lit(1).cast("long"))})
    return counted.withColumn(name, F.col(name) + (first - 1))


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1
) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts to ``n`` per key before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
