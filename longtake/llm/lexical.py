"""Ranked lexical search with the Best Position Algorithm.

Documents become compact rows of terms and counts; counts of documents and terms are taken over all
of them. Documents are then dealt into parts of bounded size, and every part becomes an index: per
term a list of its documents by impact, and the same list by document for direct access. A query
reads its lists from the top. Every document that turns up is looked up in all the other lists, and
the positions found there count as seen too. The best position of a list is the last one up to
which all were seen; no document unseen so far can score more than the impacts at the best
positions add up to. A part stops when that is strictly under its own k-th score, as a tie could
still be won by a smaller doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# What is part of a term in UTF-8: every byte that is no control character, space or sign in ASCII.
TERM_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
PART_POSTINGS = 1 << 20  # postings of one part of the index
PART_QUERIES = 1 << 16  # (query, term) rows that meet a part at once
FIRST_READ = 32  # positions read from each list at first; doubled each time


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_TABLE).split() if text else []


def counted(rows: DataFrame, key: str) -> DataFrame:
    """(row, key, n, terms, counts): the distinct terms of every text; one with none has empty arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(terms(t)) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "row": batch["row"], "id": batch["id"], "n": [c.total() for c in found],
                    "terms": [[t.decode() for t in c] for c in found], "counts": [list(c.values()) for c in found],
                }
            )

    # Null ids travel as nulls of a nullable type only if no batch turns them into floats: send text.
    picked = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("id"), "text")
    told = picked.mapInPandas(run, "row long, id string, n long, terms array<string>, counts array<long>")
    return told.withColumn("id", F.col("id").cast("long"))


class Part:
    """The index of one part: postings by term, in the order of impact and in that of documents."""

    def __init__(self, postings: pd.DataFrame):
        postings = postings.sort_values(["term", "impact", "row"], ascending=[True, False, True], kind="stable")
        rows, self.docs = np.unique(postings["row"].to_numpy(), return_inverse=True)
        self.ids = np.zeros(len(rows), np.int64)
        self.ids[self.docs] = postings["doc_id"].to_numpy()
        self.impacts = postings["impact"].to_numpy()
        term = postings["term"].to_numpy()
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(term)]
        self.lists = {term[s]: (int(s), int(e)) for s, e in zip(starts, ends, strict=True)}
        self.by_doc: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def direct(self, term: str, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``docs`` in the list of a term, and whether they are in it at all."""
        if term not in self.by_doc:
            start, end = self.lists[term]
            order = np.argsort(self.docs[start:end])
            self.by_doc[term] = order, self.docs[start:end][order]
        order, sorted_docs = self.by_doc[term]
        at = np.minimum(np.searchsorted(sorted_docs, docs), len(order) - 1)
        return order[at], sorted_docs[at] == docs

    def search(self, weights: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The best ``k`` documents, their scores, and how many documents were looked at."""
        lists = [(t, w, *self.lists[t]) for t, w in weights.items() if w > 0 and t in self.lists]
        seen = [np.zeros(end - start + 1, bool) for _, _, start, end in lists]  # one more that stays unseen
        best = [0] * len(lists)  # positions up to here were all seen
        known = np.zeros(len(self.ids), bool)
        docs, values, looked = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        depth = 0
        step = FIRST_READ
        while True:
            read = [self.docs[s + depth : min(s + depth + step, e)] for _, _, s, e in lists]
            for j, part in enumerate(read):
                seen[j][depth : depth + len(part)] = True
            new = np.unique(np.concatenate(read)) if read else np.zeros(0, np.int64)
            new = new[~known[new]]
            known[new] = True
            depth += step
            step *= 2
            if len(new):
                looked += len(new)
                sums = np.zeros(len(new), np.int64)
                for j, (term, weight, start, _) in enumerate(lists):
                    at, there = self.direct(term, new)
                    seen[j][at[there]] = True
                    sums[there] += weight * self.impacts[start + at[there]]
                docs, values = np.concatenate([docs, new]), np.concatenate([values, sums])
                order = np.lexsort((self.ids[docs], -values))[:k]
                docs, values = docs[order], values[order]
            bound, left = 0, False
            for j, (_, weight, start, end) in enumerate(lists):
                best[j] += int(np.argmin(seen[j][best[j] :]))
                if best[j] < end - start:
                    left = True
                    # The last position seen without a gap; before the first none limits the list.
                    bound += weight * int(self.impacts[start + max(best[j] - 1, 0)])
            if not left or (len(values) == k and bound < values[-1]):
                some = values > 0
                return docs[some], values[some], looked


def rank(docs: DataFrame, items: DataFrame, k: int = 50, part_postings: int = PART_POSTINGS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null and
    empty texts have no term: such a document is never found and such an item finds nothing. Rows
    are documents of their own, also where they repeat; the same holds for items, so a repeated
    item_id is answered once per row. Rows of ``docs`` without doc_id count in the statistics but are
    never returned. Of equal scores the smaller doc_id comes first. Empty tables give no rows.
    """
    asked = stage(counted(items, "item_id").select("row", "id", F.explode("terms").alias("term")))
    vocabulary = asked.select("term").distinct()
    counts = stage(counted(docs, "doc_id").where("n > 0"))
    totals = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    # Only postings of terms that an item has; the side with the vocabulary is small or Spark shuffles both.
    postings = stage(
        counts.select("row", F.col("id").alias("doc_id"), "n", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        .select("row", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
        .join(vocabulary, "term", "left_semi")
    )
    every = F.lit(totals["docs"]).cast("long")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * every + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = stage(asked.join(frequency, "term").select("row", "id", "term", weight.alias("weight")).where("weight > 0"))
    postings = postings.where("doc_id is not null")
    parts = max(1, -(-postings.count() // part_postings))
    blocks = max(1, -(-weighted.count() // part_queries))
    length = 50 + F.call_function("div", 50 * F.col("n") * every, F.lit(max(totals["words"], 1)).cast("long"))
    impact = F.call_function("div", 1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 20 * length)
    indexed = postings.select(
        F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "row", "doc_id", "term", impact.alias("impact"),
    )
    queries = weighted.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"),
        F.col("row").alias("query"), F.col("id").alias("item_id"), "term", "weight",
    )

    def search(asked: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        part, found = Part(postings), []
        for query, rows in asked.groupby("query", sort=False):
            docs, values, _ = part.search(dict(zip(rows["term"], rows["weight"], strict=True)), k)
            found.append(pd.DataFrame({"query": query, "item_id": rows["item_id"].iloc[0], "doc_id": part.ids[docs], "score": values}))
        return pd.concat(found) if found else pd.DataFrame(columns=["query", "item_id", "doc_id", "score"])

    named = queries.where("item_id is not null")
    best = named.groupBy("part", "block").cogroup(indexed.groupBy("part", "block")).applyInPandas(
        search, "query long, item_id long, doc_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
