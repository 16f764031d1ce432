"""Vectors packed into blocks, and blocks of queries that meet every block of vectors.

A packed block is one row: its arrays in one binary column. So a block join moves few rows, and the
rows a task makes are those it keeps, not the pairs it looked at.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import partitions

QUERY_ROWS = 2048  # queries of one block
BLOCK_BYTES = 128 << 10  # of one packed block, so that a batch of 500 of them is 64 MB
TILE_ROWS = 2048  # vectors that meet a block of queries at once
PACKED = "part int, dim int, block long, payload binary"


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as arrays:
        return dict(arrays)


def usable(rows: DataFrame, vector: str = "embedding", below: float = float("inf")) -> DataFrame:
    """Rows with an id and a vector of at least one component, all of them finite and under ``below``."""
    finite = F.forall(vector, lambda x: F.abs(x) < F.lit(below))  # NaN counts as largest, null fails
    return rows.where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & finite)


def pack(rows: DataFrame, encode: Callable, vector: str, block_bytes: int | None = BLOCK_BYTES) -> DataFrame:
    """(part, dim, block, payload): rows of one partition and one length, packed by ``encode``.

    ``encode`` takes the matrix of vectors and a dict with an array per other column, and returns
    arrays. ``block_bytes`` None makes one block per partition and length.
    """
    names = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, kept = TaskContext.get().partitionId(), 0, {}

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal made
            parts = kept.pop(dim)
            payload = dump(**encode(np.concatenate([p[0] for p in parts]), {c: np.concatenate([p[1][c] for p in parts]) for c in names}))
            made += 1
            return pa.RecordBatch.from_pydict(
                {"part": [part], "dim": [dim], "block": [part + 1_000_003 * made], "payload": [payload]},
                pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            column = batch.column(vector)
            ends = np.asarray(column.offsets)
            values = np.asarray(column.values)
            lengths = np.diff(ends)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                matrix = values[ends[at][:, None] + np.arange(dim)]
                others = {c: batch.column(c).to_numpy(zero_copy_only=False)[at] for c in names}
                most = max(1, block_bytes // (dim * values.itemsize)) if block_bytes else len(at)
                for k in range(0, len(at), most):
                    kept.setdefault(dim, []).append((matrix[k : k + most], {c: v[k : k + most] for c, v in others.items()}))
                    if block_bytes and sum(len(p[0]) for p in kept[dim]) >= most:
                        yield emit(dim)
        for dim in list(kept):
            yield emit(dim)

    return rows.mapInArrow(run, PACKED)


def query_blocks(queries: DataFrame, encode: Callable, vector: str, rows: int = QUERY_ROWS) -> tuple[DataFrame, int]:
    """Queries dealt evenly into packed blocks of about ``rows``; and the number of parts."""
    parts = max(1, -(-queries.count() // rows))
    return stage(pack(queries.repartition(parts), encode, vector, None)), parts


class Solver:
    """What one task does with a block of queries of one length and the vectors that pass by."""

    def open(self, arrays: dict) -> None:
        raise NotImplementedError

    def more(self, arrays: dict) -> None:
        raise NotImplementedError

    def step(self, arrays: dict) -> None:
        raise NotImplementedError

    def close(self, part: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


def meet(queries: list[DataFrame], parts: int, vectors: DataFrame, solver: Callable[[], Solver], schema: str) -> DataFrame:
    """Every block of queries with every block of vectors; returns what the solvers keep.

    The first frame of ``queries`` opens a solver, the others add to it. Vectors reach a task as a
    stream, so it holds one block of queries and one tile. Where there are fewer blocks of queries
    than tasks, the vectors are cut into several streams per block.
    """
    spark = vectors.sparkSession
    tasks = max(partitions(spark), spark.sparkContext.defaultParallelism)
    streams = -(-tasks // parts)
    sides = [
        frame.select(
            "part", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"),
            F.lit(kind).alias("kind"), "block", "dim", "payload",
        )
        for kind, frame in enumerate(queries)
    ]
    passing = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.pmod(F.xxhash64("block"), F.lit(streams)).cast("int").alias("stream"),
        F.lit(len(queries)).alias("kind"), "block", "dim", "payload",
    )
    for side in sides:
        passing = passing.union(side)
    dealt = passing.repartition(tasks, "part", "stream").sortWithinPartitions("part", "stream", "kind", "block")
    last = len(queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        for (part, _), group in groupby(rows, lambda r: (r.part, r.stream)):
            solvers: dict[int, Solver] = {}
            waiting: dict[int, list[dict]] = {}

            def flush(dim: int) -> None:
                blocks = waiting.pop(dim)
                solvers[dim].step({k: np.concatenate([b[k] for b in blocks]) for k in blocks[0]})  # noqa: B023

            for row in group:
                if row.kind == 0:
                    solvers[row.dim] = solver()
                    solvers[row.dim].open(load(row.payload))
                elif row.dim not in solvers:
                    continue
                elif row.kind < last:
                    solvers[row.dim].more(load(row.payload))
                else:
                    held = waiting.setdefault(row.dim, [])
                    held.append(load(row.payload))
                    if sum(len(b["ids"]) for b in held) >= TILE_ROWS:
                        flush(row.dim)
            for dim in list(waiting):
                flush(dim)
            for one in solvers.values():
                yield from one.close(part)

    return dealt.mapInPandas(run, schema)
