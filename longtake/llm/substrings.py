"""Removal of repeated passages by recompression: equal word sequences get equal names."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, work_folder
from .common import bare, text_of
from .near import mixed
from .tokens import MEMO_LETTERS, MEMO_WORDS, shard_bounds

ROUNDS = 2
STRETCH = 200_000  # words that are named at once
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)
_B_BACK = np.uint64(pow(int(_B), -1, 1 << 64))
_ONE = np.uint64(1)


class Names:
    """Names of words; equal words have equal names in every task."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        memo, slow = self.memo, self._word
        return np.fromiter((memo.get(w) or slow(w) for w in words), np.uint64, len(words))


_NAMES = Names()  # of this Python worker


def window_names(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A name for the ``width`` words at each start that depends on these words alone.

    In every round the sequence is recompressed: a run of one symbol becomes one symbol, then a
    symbol of the left class followed by one of the right class becomes one symbol; classes and new
    names follow from the old names. Inside equal windows all symbols come out equal but those at
    the rims, where a run may go on or a partner may stand outside. These are taken off at each
    step and named by themselves; with the symbols that are left in the middle they spell the
    window. ``mixed`` gives the names, so that all tasks agree without an exchange.
    """
    symbols = words
    i, j = starts.astype(np.int64), starts.astype(np.int64) + width
    left, right = np.zeros(len(starts), np.uint64), np.full(len(starts), _C)
    for turn in range(ROUNDS):
        # Runs. What a window holds of its first and of its last run is taken off.
        fresh = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        begin = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        end = np.append(begin[1:], len(symbols))
        some = i < j
        a, b = np.where(some, i, 0), np.where(some, j - 1, 0)
        inside = np.minimum(end[run[a]], j) - i
        left = np.where(some, mixed(left * _A + symbols[a] + inside.astype(np.uint64)), left)
        more = some & (run[a] != run[b])
        inside = j - begin[run[b]]
        right = np.where(more, mixed(right * _A + symbols[b] + inside.astype(np.uint64)), right)
        i, j = run[a] + 1, np.where(more, run[b], run[a] + 1)
        length = (end - begin).astype(np.uint64)
        symbols = symbols[begin]
        symbols = np.where(length > 1, mixed(symbols + length * _C), symbols)
        # Pairs. A right symbol in front and a left symbol at the end may have partners outside.
        side = (mixed(symbols + np.uint64((turn + 1) * int(_B) % 2**64)) & _ONE).astype(bool)  # true: right class
        some = i < j
        a = np.where(some, i, 0)
        off = some & side[a]
        left = np.where(off, mixed(left * _A + symbols[a] + _B), left)
        i = i + off
        some = i < j
        b = np.where(some, j - 1, 0)
        off = some & ~side[b]
        right = np.where(off, mixed(right * _A + symbols[b] + _B), right)
        j = j - off
        first = np.zeros(len(symbols), bool)
        first[:-1] = ~side[:-1] & side[1:]
        second = np.concatenate([[False], first[:-1]])
        place = np.append(np.cumsum(~second) - 1, len(symbols) - second.sum())
        some = i < j
        i, j = np.where(some, place[np.where(some, i, 0)], 0), np.where(some, place[np.where(some, j, 0)], 0)
        partner = np.append(symbols[1:], _ONE)
        symbols = np.where(first, mixed(mixed(symbols + _A) + partner), symbols)[~second]
    # The middle: a polynomial over its symbols, from sums that all windows share.
    power = np.full(len(symbols) + 1, _B)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(symbols) + 1, _B_BACK)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * power[:-1])])
    middle = (sums[j] - sums[i]) * back[i] + (j - i).astype(np.uint64)
    return mixed(mixed(mixed(left + _A) + right) + mixed(middle + _C))


def pack_names(names: np.ndarray) -> bytes:
    """Sorted distinct names: five low bytes as they are, the growing rest as packed steps."""
    low = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    high = np.diff((names >> np.uint64(40)).astype(np.int64), prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(high.view(np.uint8).reshape(-1, 4).T).tobytes(), 1) + low


def unpack_names(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data[: len(data) - 5 * n]), np.uint8).reshape(4, n).T
    high = np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel().astype(np.uint64))
    low = np.zeros((n, 8), np.uint8)
    low[:, :5] = np.frombuffer(data[len(data) - 5 * n :], np.uint8).reshape(-1, 5)
    return (high << np.uint64(40)) | low.view("<u8").ravel()


class Chunk:
    """The windows of some whole documents: their names, and the documents they start in.

    Names do not depend on what stands around a window, so they are made for a stretch of documents
    at a time, and only names stay: eight bytes per window.
    """

    def __init__(self, group: pd.DataFrame, width: int):
        null = group["doc_id"].isna().to_numpy()
        self.doc_ids = [None if x else int(d) for x, d in zip(null, group["doc_id"], strict=True)]
        self.texts = group["text"]
        lengths, names, words, starts = [], [np.zeros(0, np.uint64)], [], []

        def name() -> None:
            if starts:
                names.append(window_names(_NAMES.of(words), np.concatenate(starts), width))
            words.clear()
            starts.clear()

        for text in self.texts:
            mine = bare(text)
            lengths.append(len(mine))
            if len(mine) >= width:
                starts.append(np.arange(len(words), len(words) + len(mine) - width + 1))
                words += mine
                if len(words) >= STRETCH:
                    name()
        name()
        lengths = np.asarray(lengths, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        ranks = {d: r for r, d in enumerate(sorted({d for d in self.doc_ids if d is not None}), 1)}
        rank = np.asarray([ranks.get(d, 0) for d in self.doc_ids], np.int32)
        counts = np.maximum(lengths - width + 1, 0)
        shift = self.offsets[:-1] - (np.cumsum(counts) - counts)
        self.starts = np.arange(int(counts.sum())) + np.repeat(shift, counts)
        self.ranks = np.repeat(rank, counts)
        self.names = np.concatenate(names)

    def distinct(self) -> np.ndarray:
        return np.unique(self.names)

    def covered(self, earlier: np.ndarray, width: int) -> np.ndarray:
        """Marks of the words to remove; ``earlier`` tells which distinct names earlier chunks hold."""
        marks = np.zeros(self.offsets[-1] + 1, np.int64)
        if len(self.names):
            _, which = np.unique(self.names, return_inverse=True)
            lowest = np.full(len(earlier), np.iinfo(np.int32).max, np.int32)
            np.minimum.at(lowest, which, self.ranks)
            gone = self.starts[earlier[which] | (lowest[which] < self.ranks)]
            np.add.at(marks, gone, 1)
            np.add.at(marks, gone + width, -1)
        return np.cumsum(marks)[:-1] > 0


def remove_repeats(docs: DataFrame, width: int = 13, *, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row without the words of repeated windows.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller
    doc_id. Kept words are joined by one space. Null text has no words; a row without id counts as
    smaller than all ids; rows that share an id are not smaller than each other, so repeated rows
    stay; other columns are ignored; an empty table gives no rows.

    Documents lie in chunks by ranges of doc_id, written once in buckets. Each chunk sends its
    distinct window names, packed, to the bucket of their leading bits, where one bit per name
    answers whether an earlier chunk holds it. A name stands for its words with 64 bits.
    """
    spark = docs.sparkSession
    bounds = np.asarray(shard_bounds(docs, chunk_bytes), np.int64)
    shared = spark.sparkContext.broadcast(bounds)  # 8 bytes per chunk
    chunks = len(bounds) + 1
    bits = max(0, (chunks // 2).bit_length())

    @F.pandas_udf("int")
    def chunk_of(doc_id: pd.Series) -> pd.Series:
        ids = np.asarray([-(2**63) if pd.isna(d) else int(d) for d in doc_id], np.int64)
        return pd.Series(np.searchsorted(shared.value, ids, side="right").astype(np.int32))

    # As text, so that null ids do not turn the others into floats on their way to Python.
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    placed = narrow.withColumn("chunk", chunk_of("doc_id"))
    name = f"repeats_{uuid.uuid4().hex}"
    (
        placed.repartition(chunks, "chunk").write.bucketBy(chunks, "chunk").option("compression", "zstd")
        .option("path", f"{work_folder(spark)}/{name}").saveAsTable(name)
    )
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name; the files stay

    def reveal(group: pd.DataFrame) -> pd.DataFrame:
        names = Chunk(group, width).distinct()
        edges = np.searchsorted(names >> np.uint64(64 - bits) if bits else np.zeros(len(names)), np.arange((1 << bits) + 1))
        rows = [
            (b, group["chunk"].iloc[0], edges[b + 1] - edges[b], pack_names(names[edges[b] : edges[b + 1]]))
            for b in range(1 << bits)
            if edges[b] < edges[b + 1]
        ]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "n", "names"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ignore_index=True)
        sizes = group["n"].to_numpy(np.int64)
        names = np.concatenate([unpack_names(d, n) for d, n in zip(group["names"], sizes, strict=True)])
        order = np.argsort(names, kind="stable")  # earlier chunks first among equal names
        again = np.concatenate([[False], names[order][1:] == names[order][:-1]])
        held = np.zeros(len(names), bool)
        held[order] = again
        parts = np.split(held, np.cumsum(sizes)[:-1])
        return group.drop(columns="names").assign(bits=[np.packbits(p).tobytes() for p in parts])

    def remove(key: tuple, group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(group, width)
        replies = replies.sort_values("bucket")
        known = [np.unpackbits(np.frombuffer(d, np.uint8), count=n) for d, n in zip(replies["bits"], replies["n"], strict=True)]
        gone = chunk.covered(np.concatenate([np.zeros(0, np.uint8), *known]).astype(bool), width)
        rows = []
        for k, (doc_id, text) in enumerate(zip(chunk.doc_ids, chunk.texts, strict=True)):
            words = bare(text)
            mine = gone[chunk.offsets[k] : chunk.offsets[k + 1]]
            kept = [w for w, g in zip(words, mine.tolist(), strict=True) if not g] if mine.any() else words
            rows.append((None if doc_id is None else str(doc_id), len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    sent = texts.groupBy("chunk").applyInPandas(reveal, "bucket int, chunk int, n long, names binary")
    replies = stage(sent.groupBy("bucket").applyInPandas(answer, "bucket int, chunk int, n long, bits binary"))
    cleaned = texts.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    cleaned = cleaned.applyInPandas(remove, "doc_id string, n_words long, n_removed long, kept string")
    return cleaned.withColumn("doc_id", F.col("doc_id").cast("long"))
