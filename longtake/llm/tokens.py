"""Token ids of all documents as wavelet shards in the shared folder, and the way back."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, work_folder
from . import wavelet
from .common import exclusive_sums, text_of

MEMO_WORDS, MEMO_LETTERS = 400_000, 64
ENCODED_WORDS = 800_000  # about 200 bytes each
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u024f]+)([!-&(-/:-@\[-`{-~]*)")  # no apostrophe: it starts contractions
# Byte-level vocabularies write the bytes that do not print as letters from U+0100 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordEncoder:
    """Ids of whole texts from a tokenizer that never joins text across ASCII white space.

    Such a tokenizer (it drops white space before it merges) gives a text the ids of its words in
    a row, so each distinct word is handed to the library once and remembered; memory is bounded
    because the memo is emptied when it is full and long words are not kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.library = Tokenizer.from_file(path)
        self.levels = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.dtype("<u2" if self.levels <= 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # The short way is taken where the library agrees on a sample of what it covers.
        self.splits = True
        sample = [*"aZ\u00e9\u0130.,", "Word", "d\u00e9j\u00e0!!", "Stra\u00dfe&&&", "x%$#", "\u00c9T\u00c9\u2026"[:3] + "|"]
        self.splits = all(self._plain(w.encode()) in (None, self._whole(w)) for w in sample)
        self.pieces.clear()

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.library.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        fresh = {w: self._plain(w) for w in words}
        rest = [w for w, i in fresh.items() if i is None]
        if rest:
            found = self.library.encode_batch([w.decode() for w in rest], add_special_tokens=False)
            fresh.update((w, np.asarray(e.ids, self.kind).tobytes()) for w, e in zip(rest, found, strict=True))
        if len(self.memo) > ENCODED_WORDS:
            self.memo.clear()
        self.memo.update((w, i) for w, i in fresh.items() if len(w) <= MEMO_LETTERS)
        return fresh

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of Latin letters and the ASCII marks after them, by the library's model alone.

        Letters and marks are tokens of their own before merging, and lower case is all that
        happens to them, so the model gets each as the bytes it knows. None for any other word.
        """
        parts = _PLAIN.fullmatch(word.decode()) if self.splits else None
        if parts is None or not parts[1].isalpha() or not (low := parts[1].lower()).isalpha():
            return None
        return self._model(low) + (self._model(parts[2]) if parts[2] else b"")

    def _model(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > ENCODED_WORDS:
                self.pieces.clear()
            known = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = np.asarray([t.id for t in self.library.model.tokenize(known)], self.kind).tobytes()
            if len(piece) <= MEMO_LETTERS:
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        words = text.encode().split() if text else []
        found = [*map(self.memo.get, words)]
        if None in found:
            fresh = self._learn([*{w for w, i in zip(words, found, strict=True) if i is None}])
            found = [fresh[w] if i is None else i for w, i in zip(words, found, strict=True)]
        return b"".join(found)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker: what one task has learned serves the next one too."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def shard_bounds(docs: DataFrame, shard_bytes: int) -> list[int]:
    """The smallest doc_id of every shard but the first, so that shards hold about equal text.

    Only ids and text sizes are moved. The list has one number per ``shard_bytes`` of text.
    """
    narrow = docs.select("doc_id", (F.octet_length(text_of()) + 64).cast("long").alias("size"))
    narrow = narrow.groupBy("doc_id").agg(F.sum("size").alias("size"))
    placed = exclusive_sums(narrow, [F.col("doc_id").asc_nulls_first()], {"before": F.col("size")})
    shard = F.floor(F.col("before") / shard_bytes).alias("shard")
    first = placed.select("doc_id", shard).groupBy("shard").agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in first.where("shard > 0 and first is not null").collect())


def write_shards(
    docs: DataFrame, tokenizer: str, folder: str | None = None, *, end_id: int = 1, shard_bytes: int = 16 << 20
) -> str:
    """Encodes every whole text and writes the shards; returns their folder.

    Documents lie in ascending doc_id order over all shards, null first; rows that share a doc_id
    stay in one shard, in order of their text. Null text is empty and has only its end id. An empty
    table writes no shard. Other columns are ignored. A shard is written under a name of its
    attempt and then moved to its own, so a repeated task replaces it by the same bytes.
    """
    spark = docs.sparkSession
    folder = folder or f"{work_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    bounds = np.asarray(shard_bounds(docs, shard_bytes), np.int64)
    shared = spark.sparkContext.broadcast(bounds)  # 8 bytes per shard

    @F.pandas_udf("int")
    def shard_of(doc_id: pd.Series) -> pd.Series:
        ids = np.fromiter((-(2**63) if d is None else int(d) for d in doc_id), np.int64, len(doc_id))
        return pd.Series(np.searchsorted(shared.value, ids, side="right").astype(np.int32))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        encoder = encoder_of(tokenizer)
        tail = np.asarray([end_id], encoder.kind).tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()

        def close(shard: int) -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), encoder.kind)
            known = np.asarray([d is not None for d in keys], bool)
            numbers = np.asarray([d if d is not None else 0 for d in keys], np.int64)
            data = wavelet.pack(ids, np.asarray(lengths, np.int64), numbers, known, encoder.levels)
            name = f"{root}/shard-{shard:08d}.wvm"
            with store.open_output_stream(f"{root}/_attempt-{attempt}-{shard}") as out:
                out.write(data)
            store.move(f"{root}/_attempt-{attempt}-{shard}", name)
            return pd.DataFrame({"shard": [shard], "n_ids": [len(ids)]})

        now, parts, keys, lengths = -1, [], [], []
        for batch in batches:
            for shard, doc_id, text in zip(batch["shard"], batch["doc_id"], batch["text"], strict=True):
                if shard != now:
                    if keys:
                        yield close(now)
                    now, parts, keys, lengths = shard, [], [], []
                ids = encoder.encode(text) + tail
                parts.append(ids)
                keys.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(len(ids) // encoder.kind.itemsize)
        if keys:
            yield close(now)

    # Ids go to Python as text, so that null ids do not turn the others into floats.
    placed = docs.withColumn("shard", shard_of(F.col("doc_id").cast("long").cast("string")))
    ordered = (
        placed.repartition(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .withColumn("doc_id", F.col("doc_id").cast("string"))
    )
    written = ordered.mapInPandas(write, "shard int, n_ids long")
    stage(written)
    return folder


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, decoded from the shards."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                shard = wavelet.WaveletShard(content)
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                raw = memoryview(ids).cast("B")
                starts = ends - shard.lengths
                yield pd.DataFrame(
                    {
                        "shard": int(name),
                        "doc_id": pd.array(shard.doc_ids, "Int64").copy() if shard.known.all() else pd.array(
                            [int(d) if k else None for d, k in zip(shard.doc_ids, shard.known, strict=True)], "Int64"
                        ),
                        "start": starts,
                        "n_tokens": shard.lengths,
                        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no shard was written
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    name = F.regexp_extract("path", r"shard-(\d+)\.wvm$", 1).alias("name")
    found = stage(files.select(name, "content").mapInPandas(read, schema))
    totals = exclusive_sums(found.groupBy("shard").agg(F.sum("n_tokens").alias("n")), ["shard"], {"base": F.col("n")})
    return (
        found.join(stage(totals.select("shard", "base")), "shard")
        .withColumn("start", F.col("start") + F.col("base"))
        .select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
    )
