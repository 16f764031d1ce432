"""Benchmark decontamination: an inverted index of test items, asked by every training passage."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = (16, 256)  # blocks of items for the first and the second bound of a passage
_TERM = re.compile(r"[^\W_]+")
LEAK = "array<struct<item_id: long, score: double, question: double, answer: double>>"


@dataclass(frozen=True)
class Leaks:
    """A passage is retrieved for an item if its BM25 score is at least ``least`` of the score that
    the item's own text would get, and is a leak if ``overlap`` of the words of the question and of
    the answer stand in it in order. The answer is the last ``answer`` part of an item's words.
    """

    k1: float = 1.2
    b: float = 0.75
    least: float = 0.6
    overlap: float = 0.8
    answer: float = 1 / 3
    block: int = 16
    items_per_index: int = 20_000


def terms_of(text: str | None) -> list[str]:
    """Letters and digits in lower case; everything else separates."""
    return _TERM.findall(text.lower()) if text else []


class ItemIndex:
    """Postings by term with BM25 impacts as parts of each item's own score, in blocks of items."""

    def __init__(self, items: list[tuple[int, str]], settings: Leaks):
        self.settings = settings
        known = [(i, t) for i, t in ((i, terms_of(x)) for i, x in items) if t]
        self.item_ids = [i for i, _ in known]
        self.items = [t for _, t in known]
        counts = [Counter(t) for t in self.items]
        n, mean = len(known), sum(map(len, self.items)) / max(1, len(known))
        df = Counter(t for c in counts for t in c)
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.ids = {t: k for k, t in enumerate(sorted(df))}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for doc, c in enumerate(counts):
            length = settings.k1 * (1 - settings.b + settings.b * len(self.items[doc]) / mean)
            impact = {t: idf[t] * f * (settings.k1 + 1) / (f + length) for t, f in c.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[self.ids[t]].append((doc, x / own))
        self.docs = {t: [d for d, _ in p] for t, p in postings.items()}
        self.impacts = {t: [x for _, x in p] for t, p in postings.items()}
        self.most = np.zeros(len(self.ids) + 1)  # the last entry is for unknown terms
        for t, x in self.impacts.items():
            self.most[t] = max(x)
        self.block_most = {
            t: {b: max(x for d, x in p if d // settings.block == b) for b in {d // settings.block for d, _ in p}}
            for t, p in postings.items()
        }
        self.longest = max(map(len, self.items), default=0)
        self._bound()

    def _bound(self) -> None:
        """Block bounds for whole passages, over coarse and fine blocks of items.

        ``rare[t, g]`` is the largest impact of a term on an item of block g. Frequent terms are
        zero there; what all of them together add to any one item of the block is ``common[g]``. As
        many count as frequent as keep that below half of what retrieval asks for.
        """
        share = np.zeros(len(self.items))
        frequent, rest = True, []
        for t in sorted(self.docs, key=lambda t: (-len(self.docs[t]), t)):
            if frequent:
                more = share.copy()
                more[self.docs[t]] += self.impacts[t]
                frequent = more.max() <= self.settings.least / 2
            if frequent:
                share = more
            else:
                rest.append(t)
        self.bounds = []
        for groups in BLOCKS:
            size = max(1, -(-len(self.items) // groups))
            rare = np.zeros((len(self.ids) + 1, -(-len(self.items) // size)), np.float32)
            for t in rest:
                np.maximum.at(rare[t], np.asarray(self.docs[t]) // size, self.impacts[t])
            self.bounds.append((rare, np.asarray([share[g : g + size].max() for g in range(0, len(share), size)])))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold: WAND with block maxima, item by item.

        ``terms`` are the distinct known terms of a passage.
        """
        least = self.settings.least - 1e-9
        block = self.settings.block
        lists = [[self.docs[t], self.impacts[t], self.block_most[t], float(self.most[t]), 0] for t in terms.tolist()]
        found = []
        while lists:
            lists.sort(key=lambda p: p[0][p[4]])
            bound, pivot = 0.0, -1
            for k, p in enumerate(lists):
                bound += p[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            at = item // block
            if sum(p[2].get(at, 0.0) for p in lists[: pivot + 1]) < least:
                # No item of this block up to the next list's item can reach the threshold.
                ahead = lists[pivot + 1][0][lists[pivot + 1][4]] if pivot + 1 < len(lists) else math.inf
                goal = min((at + 1) * block, max(ahead, item + 1))
                moved = lists[: pivot + 1]
            elif lists[0][0][lists[0][4]] == item:
                score = sum(p[1][p[4]] for p in lists[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                goal, moved = item + 1, lists[: pivot + 1]
            else:
                goal, moved = item, [p for p in lists[:pivot] if p[0][p[4]] < item]
            for p in moved:
                docs, i = p[0], p[4]
                while i < len(docs) and docs[i] < goal:
                    i += 1
                p[4] = i
            lists = [p for p in lists if p[4] < len(p[0])]
        return found


def in_order(part: list[str], passage: list[str]) -> float:
    """Share of the words of ``part`` that stand in the passage in order."""
    if not part:
        return 1.0
    row = [0] * (len(passage) + 1)
    for word in part:
        left = 0
        for j, other in enumerate(passage):
            above = row[j + 1]
            row[j + 1] = left + 1 if word == other else max(above, row[j])
            left = above
    return row[-1] / len(part)


class Detector:
    """Leaks of one text."""

    def __init__(self, index: ItemIndex):
        self.index = index

    def passages(self, words: list[str]) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, distinct known terms) of the passages that could reach the threshold.

        Passages are twice as long as the longest item and begin every half of that, so any item
        that a text holds lies whole in one of them.
        """
        index = self.index
        if not words or not index.items:
            return []
        unknown = len(index.ids)
        ids = np.fromiter(map(index.ids.get, words, repeat(unknown)), np.int32, len(words))
        (coarse, coarse_common), (fine, fine_common) = index.bounds
        least = index.settings.least - 1e-4  # the bounds are single floats
        # Sums over stretches of one step, then over the two stretches of each passage.
        step = max(index.longest, 16)
        firsts = np.arange(0, len(ids), step)
        sums = np.add.reduceat(coarse[ids], firsts, axis=0)
        sums = sums[:1] if len(sums) == 1 else sums[:-1] + sums[1:]
        found = []
        for k in np.flatnonzero((sums + coarse_common >= least).any(axis=1)).tolist():
            start, end = int(firsts[k]), int(min(firsts[k] + 2 * step, len(ids)))
            distinct = np.unique(ids[start:end])
            if (fine[distinct].sum(axis=0) + fine_common >= least).any():
                found.append((start, end, distinct[distinct < unknown]))
        return found

    def leaks(self, text: str | None) -> list[dict]:
        index, settings = self.index, self.index.settings
        best: dict[int, tuple] = {}
        words = terms_of(text)
        for start, end, terms in self.passages(words):
            for item, score in index.search(terms):
                passage, whole = words[start:end], index.items[item]
                cut = len(whole) - max(1, round(len(whole) * settings.answer))
                question, answer = in_order(whole[:cut], passage), in_order(whole[cut:], passage)
                if min(question, answer) >= settings.overlap:
                    best[item] = max(best.get(item, ()), (score, question, answer))
        return [
            {"item_id": index.item_ids[i], "score": s, "question": q, "answer": a} for i, (s, q, a) in sorted(best.items())
        ]


def leaks(docs: DataFrame, items: DataFrame, settings: Leaks = Leaks()) -> list[Column]:
    """One column per index with the leaks (item_id, score, question, answer) of each whole text.

    Items go to the tasks in indexes of a bounded number of items, each with terms and statistics
    of its own. Items without id or without a word are never found; null and empty texts have no
    leak; an item given twice is found twice.
    """
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").sort("item_id", "text")
    spark, columns, chunk = docs.sparkSession, [], []

    def add() -> None:
        shared = spark.sparkContext.broadcast(list(chunk))

        def find(texts: pd.Series) -> pd.Series:
            detector = _DETECTORS.get(shared.value, settings)
            return pd.Series([detector.leaks(t) for t in texts])

        columns.append(F.pandas_udf(find, LEAK)("text"))

    for row in rows.toLocalIterator():
        chunk.append((row["item_id"], row["text"]))
        if len(chunk) == settings.items_per_index:
            add()
            chunk = []
    if chunk:
        add()
    return columns


class _Kept:
    """The last detector of a Python worker, so that batches do not build the index anew."""

    def __init__(self):
        self.key, self.detector = None, None

    def get(self, items: list, settings: Leaks) -> Detector:
        key = (hash(tuple(items)), settings)
        if key != self.key:
            self.key, self.detector = key, Detector(ItemIndex(items, settings))
        return self.detector


_DETECTORS = _Kept()


def leaked(docs: DataFrame, items: DataFrame, settings: Leaks = Leaks()) -> DataFrame:
    """(doc_id, item_id, score, question, answer) for every leak of every row of ``docs``."""
    found = [docs.select("doc_id", F.explode(c).alias("leak")) for c in leaks(docs, items, settings)]
    if not found:
        return docs.select("doc_id", F.explode(F.array().cast(LEAK)).alias("leak")).select("doc_id", "leak.*")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.select("doc_id", "leak.*")


def clean(docs: DataFrame, items: DataFrame, settings: Leaks = Leaks()) -> DataFrame:
    """``docs`` without the rows that leak; all columns stay as they are."""
    for column in leaks(docs, items, settings):
        docs = docs.where(F.size(column) == 0)
    return docs
