"""Nearest neighbours by inner product: a block matrix join with quantised tiles.

Every vector is kept with 8-bit codes, their scale, and the length of what the codes leave out. A
tile is the product of the codes of a block of queries and a block of vectors. By Cauchy-Schwarz
the true product differs from the tile's by at most |q'| |x - x'| + |q - q'| |x|, so a pair whose
upper bound is under the k-th lower bound cannot be among the nearest. All other pairs are computed
again on the original vectors in double precision and go into a heap per query.

The search is exact: no index is fitted and no row is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import Solver, meet, pack, query_blocks, usable

PAIRS_AT_ONCE = 100_000
ROUNDING = 4e-16  # of one addition or product in double precision, with room
EXACT_SINGLE = 2**24 // 127**2  # components up to which sums of code products are exact in single precision


def quantise(matrix: np.ndarray) -> dict[str, np.ndarray]:
    """8-bit codes of each row with scale, length, length of the coded vector and of the rest."""
    x = matrix.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.maximum(np.abs(x).max(axis=1) / 127, 5e-324)
        code = np.clip(np.rint(x / scale[:, None]), -127, 127)
        coded = code * scale[:, None]
        return {
            "x": matrix,
            "code": code.astype(np.int8),
            "scale": scale,
            "norm": np.sqrt((x * x).sum(axis=1)),
            "coded": np.sqrt((coded * coded).sum(axis=1)),
            "rest": np.sqrt(((x - coded) ** 2).sum(axis=1)),
        }


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added component by component."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return total


class NearestSolver(Solver):
    def __init__(self, k: int):
        self.k = k

    def open(self, arrays: dict) -> None:
        self.q = arrays
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in arrays["ids"]]
        self.worst = np.full(len(self.heaps), -np.inf)

    def step(self, v: dict) -> None:
        q, k, dim = self.q, self.k, self.q["x"].shape[1]
        kind = np.float32 if dim <= EXACT_SINGLE else np.float64
        tile = (q["code"].astype(kind) @ v["code"].astype(kind).T).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            tile *= q["scale"][:, None]
            tile *= v["scale"]
            slack = np.outer(q["coded"], v["rest"]) + np.outer(q["rest"] + 2 * dim * ROUNDING * q["norm"], v["norm"])
            slack *= 1 + 1e-9
            upper, lower = tile + slack, tile - slack
        own = q["ids"][:, None] == v["ids"]
        lower[own | np.isnan(lower)] = -np.inf
        bar = self.worst
        if lower.shape[1] >= k:
            bar = np.maximum(bar, np.partition(lower, -k, axis=1)[:, -k])
        rows, columns = np.nonzero(~(upper < bar[:, None]) & ~own)  # a bound that is no number excludes nothing
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            self._keep(rows[at : at + PAIRS_AT_ONCE], columns[at : at + PAIRS_AT_ONCE], v)

    def _keep(self, rows: np.ndarray, columns: np.ndarray, v: dict) -> None:
        scores = products(self.q["x"][rows], v["x"][columns])
        fit = scores >= self.worst[rows]
        for row, score, vec in zip(rows[fit].tolist(), scores[fit].tolist(), v["ids"][columns[fit]].tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            else:
                heapq.heappushpop(heap, (score, -vec))
            if len(heap) == self.k:
                self.worst[row] = heap[0][0]

    def close(self, part: int) -> Iterator[pd.DataFrame]:
        dim = self.q["x"].shape[1]
        found = [(i, score, -vec) for i, heap in enumerate(self.heaps) for score, vec in heap]
        at = [f[0] for f in found]
        yield pd.DataFrame(
            {
                "part": part, "dim": dim, "at": at, "query_id": self.q["ids"][at],
                "vec_id": [f[2] for f in found], "score": [f[1] for f in found],
            }
        )


def _encode(copies: int | None):
    """Packs vectors; of equal vectors of one block only those that can be among the nearest stay."""

    def encode(matrix: np.ndarray, others: dict) -> dict[str, np.ndarray]:
        ids = others["vec_id"].astype(np.int64)
        if copies is not None:
            order = np.argsort(ids, kind="stable")
            _, group = np.unique(matrix[order], axis=0, return_inverse=True)
            group = group.reshape(-1)
            by_group = np.argsort(group, kind="stable")
            first = np.searchsorted(group[by_group], group[by_group])
            stay = order[by_group[np.arange(len(ids)) - first < copies]]
            matrix, ids = matrix[stay], ids[stay]
        return {"ids": ids, **quantise(matrix)}

    return encode


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each query.

    ``rows`` has ``vec_id`` and ``vector``; a query is a row where ``is_query`` holds. Rows with a
    null vec_id, or a vector that is null, empty, zero or has a null or non-finite component take
    no part. Rows with the query's own vec_id are not its neighbours; otherwise repeated rows count
    each, and a repeated query is answered each time. Ties go to the smaller vec_id. Vectors meet
    only vectors of their own length. An empty table gives no rows; other columns are ignored.
    """
    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    known = usable(picked, "vector").where(F.exists("vector", lambda x: x != 0))
    queries, parts = query_blocks(known.where("asks").drop("asks"), _encode(None), "vector")
    # k + 1 equal vectors with smaller ids, at most one of them the query itself, are enough to rule a row out.
    vectors = stage(pack(known.drop("asks"), _encode(k + 1), "vector"))
    found = meet([queries], parts, vectors, lambda: NearestSolver(k), "part int, dim int, at int, query_id long, vec_id long, score double")
    order = Window.partitionBy("part", "dim", "at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
