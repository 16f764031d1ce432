"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import bare

MEMO_WORDS, MEMO_LETTERS = 400_000, 64
_RUNS = re.compile(r"(.)\1+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """``sample`` bounds the labelled documents that are learned from, lowest hashes first."""

    sample: int = 12_000
    epochs: int = 3
    bits: int = 18
    scale: float = 30.0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.01
    threshold: float = 0.3


def shape(word: str) -> str:
    """Letters by case, digits as 9, other characters as they are; runs count once."""
    marks = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _RUNS.sub(r"\1", marks)


class Grams:
    """Hashed n-grams of a text: words and pairs of words, as they are and by their shape."""

    def __init__(self, bits: int):
        self.bits = bits
        self.memo: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        text = word.decode()
        pair = xxhash.xxh32_intdigest(text.lower().encode()) << 32 | xxhash.xxh32_intdigest(shape(text).encode(), seed=1)
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = pair
        return pair

    def of(self, text: str | None) -> np.ndarray:
        """Indices of all n-grams, repeated as often as they occur; empty for an empty text."""
        words = bare(text)
        if not words:
            return np.zeros(0, np.int64)
        memo, slow = self.memo, self._word
        pairs = np.fromiter((memo.get(w) or slow(w) for w in words), np.uint64, len(words))
        word, form = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        found = []
        for salt, view in enumerate((word, form)):
            found.append(view + np.uint64(salt << 32))
            found.append((view[:-1] * np.uint64(31) + view[1:]) ^ np.uint64((salt + 2) << 33))
        every = np.concatenate(found) * _MIX
        return (every >> np.uint64(64 - self.bits)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a row without id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, settings: Model = Model()) -> np.ndarray:
    """Weights (and the bias at the end) learned from a bounded sample of labelled documents.

    Labels without id or quality are left out; a document labelled twice counts with its larger
    label. The sample is read once per epoch in a fixed order, in one task that holds weights and
    one batch at a time; without any labelled document all weights are 0.
    """
    known = labels.where("quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = known.withColumn("at", order).orderBy("at", "doc_id").limit(settings.sample)
    bits, scale = settings.bits, settings.scale

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(bits)
        for batch in batches:
            rows = []
            for at, quality, text in zip(batch["at"], batch["quality"], batch["text"], strict=True):
                index, count = np.unique(grams.of(text), return_counts=True)
                value = (count * (scale / max(1, count.sum()))).astype("<f4")
                rows.append((at, quality, index.astype("<i4").tobytes(), value.tobytes()))
            yield pd.DataFrame(rows, columns=["at", "quality", "index", "value"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = (1 << bits) + 1
        z, n = np.zeros(size), np.zeros(size)
        for batch in batches:
            for quality, index, value in zip(batch["quality"], batch["index"], batch["value"], strict=True):
                i = np.append(np.frombuffer(index, "<i4"), size - 1)
                x = np.append(np.frombuffer(value, "<f4").astype(np.float64), 1.0)
                w = weights(z[i], n[i])
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - quality) * x
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / settings.alpha * w
                n[i] += g * g
        yield pd.DataFrame({"weights": [weights(z, n).astype("<f4").tobytes()]})

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - settings.l1, 0)
        return -shrunk / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)

    # The sample is bounded by a setting, and so is what is broadcast here.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("at", "quality", "text")
    rows = stage(sample.mapInPandas(featurise, "at long, quality int, index binary, value binary"))
    passes = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(settings.epochs))))
    one = passes.repartition(1).sortWithinPartitions("epoch", "at", "index", "value").select("quality", "index", "value")
    learned = one.mapInPandas(learn, "weights binary").first()
    return np.frombuffer(learned["weights"], "<f4") if learned else np.zeros((1 << bits) + 1, "<f4")


def score(docs: DataFrame, weights: np.ndarray, settings: Model = Model()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null text scores as empty (the bias).

    Repeated rows are scored each. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes times 2 to the bits
    bits, scale, least = settings.bits, settings.scale, settings.threshold

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, w = Grams(bits), shared.value.astype(np.float64)
        for batch in batches:
            index = [grams.of(t) for t in batch["text"]]
            raw = np.asarray([w[-1] + (scale * w[i].mean() if len(i) else 0.0) for i in index])
            p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": (p >= least).astype(np.int32)}
            )

    # The id travels as text, so that a null does not turn its neighbours into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    rated = rows.mapInPandas(rate, "doc_id string, held_out boolean, score double, predicted int")
    return rated.withColumn("doc_id", F.col("doc_id").cast("long"))
