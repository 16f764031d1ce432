"""Hard negatives: rows of another label that score just under the positives of an anchor.

Components are whole numbers, floor(256 x). Every vector v is turned by one random rotation; its
code is one sign bit per turned component. The signs, as a vector of length one, are its code
vector c; stored beside the bits are |v| and the alignment a = <v/|v|, c>. An anchor's turned
direction u is cut to eight bit planes, so <u, c> is a sum of popcounts, off by at most what the
planes leave out. With t = <u, c>, Cauchy-Schwarz on the parts across c gives
|<u, v/|v|> - a t| <= sqrt(1 - a^2) sqrt(1 - t^2): an interval that always holds the score. Only
pairs whose interval reaches a place that is still open are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .blocks import Solver, dump, meet, pack, query_blocks, usable

SCALE = 256
PLANES = 8
SEED = 11
LARGEST = float(2**54)  # components above have no whole number of 64 bits
ROOM = 1e-9  # for rounding, as a share of both lengths
PAIRS_AT_ONCE = 100_000
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    """One rotation per length of vector, the same in every task."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def whole(matrix: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * matrix.astype(np.float64)).astype(np.int64)


def bits(rows: np.ndarray) -> np.ndarray:
    """Truth values packed into 64-bit words."""
    packed = np.packbits(rows, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _smallest(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    for kind in (np.int16, np.int32):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind)
    return v


def encode_rows(matrix: np.ndarray, others: dict) -> dict[str, np.ndarray]:
    v = whole(matrix)
    turned = v.astype(np.float64) @ rotation(v.shape[1])
    norm = np.sqrt((turned * turned).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        align = np.where(norm > 0, np.abs(turned).sum(axis=1) / (norm * np.sqrt(v.shape[1])), 1.0)
    code = bits(turned >= 0)
    return {
        "ids": others["vec_id"].astype(np.int64), "labels": others["label"].astype(np.int64), "v": _smallest(v),
        "code": code, "ones": np.bitwise_count(code).sum(axis=1, dtype=np.int32),
        "norm": norm, "align": np.minimum(align, 1.0),
    }


def encode_anchors(matrix: np.ndarray, others: dict) -> dict[str, np.ndarray]:
    v = whole(matrix)
    turned = v.astype(np.float64) @ rotation(v.shape[1])
    norm = np.sqrt((turned * turned).sum(axis=1))
    u = turned / np.where(norm > 0, norm, 1.0)[:, None]
    low = u.min(axis=1)
    step = np.maximum(u.max(axis=1) - low, 1e-300) / (2**PLANES - 1)
    level = np.clip(np.rint((u - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint32)
    cut = low[:, None] + step[:, None] * level
    return {
        "ids": others["vec_id"].astype(np.int64), "labels": others["label"].astype(np.int64), "v": _smallest(v), "norm": norm,
        "planes": np.stack([bits((level >> j) & 1) for j in range(PLANES)]),
        "low": low, "step": step, "total": cut.sum(axis=1), "off": np.sqrt(((u - cut) ** 2).sum(axis=1)),
    }


def intervals(anchors: dict, rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of a block of anchors and a block of rows."""
    planes, code = anchors["planes"], rows["code"]
    counts = np.zeros((planes.shape[1], len(code)))
    for j in range(PLANES):
        for w in range(code.shape[1]):
            counts += np.bitwise_count(planes[j, :, w][:, None] & code[:, w]).astype(np.float64) * (1 << j)
    ones = anchors["low"][:, None] * rows["ones"] + anchors["step"][:, None] * counts
    t = (2 * ones - anchors["total"][:, None]) / np.sqrt(rows["v"].shape[1])
    first, last = np.maximum(t - anchors["off"][:, None], -1.0), np.minimum(t + anchors["off"][:, None], 1.0)
    first, last = np.minimum(first, 1.0), np.maximum(last, -1.0)
    align, across = rows["align"], np.sqrt(1 - rows["align"] ** 2 + 1e-14)
    near, far = np.clip(align, first, last), np.clip(-align, first, last)
    upper = align * near + across * np.sqrt(1 - near**2 + 1e-14) + ROOM
    lower = align * far - across * np.sqrt(1 - far**2 + 1e-14) - ROOM
    size = np.outer(anchors["norm"], rows["norm"])
    return lower * size, upper * size


def scores(anchors: dict, rows: dict, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the given pairs."""
    if not len(at):
        return np.zeros(0, np.int64)
    a, b = anchors["v"], rows["v"]
    if len(at) * 8 > len(a) * len(b) and anchors["norm"].max() * rows["norm"].max() < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T)[at, to].astype(np.int64)  # no sum is rounded
    out = np.empty(len(at), np.int64)
    for k in range(0, len(at), PAIRS_AT_ONCE):
        i, j = at[k : k + PAIRS_AT_ONCE], to[k : k + PAIRS_AT_ONCE]
        out[k : k + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", a[i].astype(np.int64), b[j].astype(np.int64))
    return out


def _best(kept: tuple, ids: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` highest values, ties by smaller id, of what was kept and what is new."""
    ids, values = np.concatenate([kept[0], ids]), np.concatenate([kept[1], values])
    order = np.lexsort((ids, -values))[:most]
    return ids[order], values[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class PositiveSolver(Solver):
    """The best rows of the anchor's own label."""

    def __init__(self, most: int):
        self.most = most

    def open(self, arrays: dict) -> None:
        self.a = arrays
        self.kept = [_NONE] * len(arrays["ids"])
        self.bar = np.full(len(self.kept), -np.inf)

    def step(self, rows: dict) -> None:
        able = (self.a["labels"][:, None] == rows["labels"]) & (self.a["ids"][:, None] != rows["ids"])
        lower, upper = intervals(self.a, rows)
        bar = self.bar
        if lower.shape[1] >= self.most:
            bar = np.maximum(bar, np.partition(np.where(able, lower, -np.inf), -self.most, axis=1)[:, -self.most])
        at, to = np.nonzero(able & (upper >= bar[:, None]))
        values = scores(self.a, rows, at, to)
        ends = np.searchsorted(at, np.arange(len(self.kept) + 1))
        for i in np.unique(at).tolist():
            part = slice(ends[i], ends[i + 1])
            self.kept[i] = _best(self.kept[i], rows["ids"][to[part]], values[part], self.most)
            if len(self.kept[i][0]) == self.most:
                self.bar[i] = self.kept[i][1][-1]

    def close(self, part: int) -> Iterator[pd.DataFrame]:
        at = np.repeat(np.arange(len(self.kept)), [len(k[0]) for k in self.kept])
        yield pd.DataFrame(
            {
                "part": part, "dim": self.a["v"].shape[1], "at": at,
                "positive_id": np.concatenate([k[0] for k in self.kept]), "score": np.concatenate([k[1] for k in self.kept]),
            }
        )


class NegativeSolver(Solver):
    """For every positive of an anchor, the best rows of other labels inside the positive's window."""

    def __init__(self, most: int, window: tuple[int, int]):
        self.most, self.window = most, window

    def open(self, arrays: dict) -> None:
        self.a = arrays
        self.columns: list[dict] = []
        self.kept: dict[tuple[int, int], tuple] = {}

    def more(self, arrays: dict) -> None:
        """Positives as (at, n, positive_id, score): the n-th one of each anchor is a column of windows."""
        at, n, score = arrays["at"], arrays["n"], arrays["score"]
        for j in range(int(n.max()) + 1 if len(n) else 0):
            these = n == j
            column = {
                "least": np.full(len(self.a["ids"]), np.iinfo(np.int64).max), "most": np.full(len(self.a["ids"]), np.iinfo(np.int64).min),
                "id": np.zeros(len(self.a["ids"]), np.int64), "score": np.zeros(len(self.a["ids"]), np.int64),
            }
            whole_scores = score[these].tolist()
            column["least"][at[these]] = [-(-self.window[0] * s // 100) for s in whole_scores]
            column["most"][at[these]] = [self.window[1] * s // 100 for s in whole_scores]
            column["id"][at[these]], column["score"][at[these]] = arrays["positive_id"][these], score[these]
            self.columns.append(column)

    def step(self, rows: dict) -> None:
        lower, upper = intervals(self.a, rows)
        wanted = np.zeros(lower.shape, bool)
        for c in self.columns:
            wanted |= (upper >= c["least"][:, None]) & (lower <= c["most"][:, None]) & (c["least"] <= c["most"])[:, None]
        wanted &= self.a["labels"][:, None] != rows["labels"]
        at, to = np.nonzero(wanted)
        values, ids = scores(self.a, rows, at, to), rows["ids"][to]
        ends = np.searchsorted(at, np.arange(len(self.a["ids"]) + 1))
        for j, c in enumerate(self.columns):
            fit = (values >= c["least"][at]) & (values <= c["most"][at])
            for i in np.unique(at[fit]).tolist():
                part = slice(ends[i], ends[i + 1])
                inside = fit[part]
                best = _best(self.kept.get((i, j), _NONE), ids[part][inside], values[part][inside], self.most)
                self.kept[i, j] = best
                if len(best[0]) == self.most:
                    c["least"][i] = best[1][-1]  # what scores less has no place any more

    def close(self, part: int) -> Iterator[pd.DataFrame]:
        keys = list(self.kept)
        sizes = [len(self.kept[key][0]) for key in keys]
        at, n = (np.repeat(np.array([key[side] for key in keys], np.int64), sizes) for side in (0, 1))
        of = lambda name: np.concatenate([np.repeat(self.columns[j][name][i], m) for (i, j), m in zip(keys, sizes, strict=True)] or [_NONE[0]])
        yield pd.DataFrame(
            {
                "part": part, "dim": self.a["v"].shape[1], "at": at, "n": n, "anchor_id": self.a["ids"][at],
                "positive_id": of("id"), "positive_score": of("score"),
                "negative_id": np.concatenate([self.kept[key][0] for key in keys] or [_NONE[0]]),
                "negative_score": np.concatenate([self.kept[key][1] for key in keys] or [_NONE[0]]),
            }
        )


_POSITIVES = "part int, dim int, at int, positive_id long, score long"
_NEGATIVES = "part int, dim int, at int, n int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _packed_positives(best: DataFrame) -> DataFrame:
    """One row per block of anchors; a block has at most a few thousand anchors."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        payload = dump(**{c: rows[c].to_numpy() for c in ("at", "n", "positive_id", "score")})
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "dim": [rows["dim"].iloc[0]], "block": [0], "payload": [payload]})

    return best.groupBy("part", "dim").applyInPandas(one, "part int, dim int, block long, payload binary")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has ``vec_id`` and ``vector``; ``label`` gives each row its label. The positives of an
    anchor are the highest scoring other rows of its label; for each, the highest scoring rows of
    other labels with window[0] * p <= 100 * score <= window[1] * p are its negatives. Rows with a
    null vec_id or label, or a vector that is null, empty or has a component that is null, not
    finite or of 2^54 and more, take no part. Ties go to the smaller vec_id. Rows with the anchor's vec_id are
    not its positives; otherwise repeated rows count each. Vectors meet only vectors of their own
    length. A positive of negative score has no negatives. Empty tables give no rows; other columns
    are ignored.
    """
    picked = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"),
        label.cast("long").alias("label"), is_anchor.alias("asks"),
    )
    known = usable(picked, "vector", LARGEST).where("label is not null")
    anchors, parts = query_blocks(known.where("asks").drop("asks"), encode_anchors, "vector")
    packed = stage(pack(known.drop("asks"), encode_rows, "vector"))
    order = Window.partitionBy("part", "dim", "at").orderBy(F.desc("score"), "positive_id")
    found = meet([anchors], parts, packed, lambda: PositiveSolver(positives), _POSITIVES)
    best = found.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < positives)
    chosen = stage(_packed_positives(best))
    held = meet([anchors, chosen], parts, packed, lambda: NegativeSolver(negatives, window), _NEGATIVES)
    order = Window.partitionBy("part", "dim", "at", "n").orderBy(F.desc("negative_score"), "negative_id")
    ranked = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
