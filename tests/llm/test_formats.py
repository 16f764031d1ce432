"""Chat formatting and token shards: exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from longtake.llm import chat, queries, tokens, wavelet

TURNS = "conv_id long, turn long, role string, text string"


def read(spark, rows):
    chats = chat.format_chats(spark.createDataFrame(rows, TURNS))
    read = chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("l"))
    return {r["conv_id"]: r for r in read.collect()}


def test_control_strings_come_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|message|>", r"<\|turn|>", r"<\\s>", "<<SYS>>[<", "", "a<|", "<|turn|>"]
    rows = [(c, i, "assistant" if i % 2 else "user", t) for c in range(3) for i, t in enumerate(nasty[c:] + nasty[:c])]
    got = read(spark, rows)
    for c in range(3):
        mine = [r for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c]["t"]] == [(r[2], r[3]) for r in mine]
        assert got[c]["l"] == "".join(r[3] for r in mine if r[2] == "assistant")


def test_same_role_turns_are_merged_and_stay_apart(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d"), (None, 0, None, None)]
    got = read(spark, rows)
    assert got[1]["formatted"] == "<|im_start|>user<|message|>a<|turn|>b<|im_end|>\n<|im_start|>assistant<|message|>c<|turn|>d<|im_end|>\n"
    assert got[1]["l"] == "cd"
    assert [tuple(t) for t in got[None]["t"]] == [("", "")]


def test_ties_repeated_rows_and_no_rows(spark):
    got = read(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z")])
    assert [t["text"] for t in got[1]["t"]] == ["z", "a", "a", "b"]
    assert read(spark, []) == {}


def test_random_texts(spark):
    rng = random.Random(5)
    bits = ["<", "|", "s>", "/", "[", "INST]", "\\", "im_end", "|>", "turn", "x", "\n", "<|im_end|>\n", "</s>"]
    rows = [(c, i, rng.choice(["user", "assistant", "sys<s>"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(60) for i in range(5)]
    got = read(spark, rows)
    for c in range(60):
        assert [tuple(t) for t in got[c]["t"]] == [(r[2], r[3]) for r in rows if r[0] == c]


@pytest.mark.parametrize("n", [0, 1, 7, 300_000])
def test_wavelet_matrix_against_the_plain_row(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 49_407)
    shard = wavelet.WaveletShard(wavelet.pack(ids, np.asarray([n]), np.asarray([4]), np.asarray([True]), 16))
    assert (shard.decode() == ids).all()
    for token in (1, 2, 90, 49_407, 5_000):
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where)
        assert shard.count(token, n // 2) == (where < n // 2).sum()
        assert shard.occurrence(token, len(where)) == -1
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert shard.occurrence(token, k) == where[k]
    for i in {0, n // 3, n - 1} if n else ():
        assert shard.access(i) == ids[i]


def test_shards_hold_what_the_library_encodes(spark, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = {
        7: "Hello  World's\tdon't\x0bstop\x1cnow here <|endoftext|> x<|startoftext|>y", 3: None, 5: "", 9: "É é ßé Σας 12.5%",
        11: "word " * 40_000, 12: "a" * 3_000, None: "no id", 2: "　wide sep\x85end",
    }
    rows = [*texts.items(), (7, "second row of seven"), (7, "second row of seven")]
    folder = tokens.write_shards(documents(rows, extra=True), path, shard_bytes=50_000)
    got = sorted((tuple(r) for r in tokens.read_documents(spark, folder).drop("shard").collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.read_documents(spark, tokens.write_shards(documents([]), path)).count() == 0


def test_shards_keep_the_order_of_large_ids_beside_a_null(spark, documents):
    ids = [2**60 + 3 * i for i in range(60)]
    rows = [(d, f"text {i} " * 20) for i, d in enumerate(ids)]
    random.Random(5).shuffle(rows)

    def read(rows):
        folder = tokens.write_shards(documents(rows).coalesce(1), queries.tokenizer_path(), shard_bytes=1_500)
        return sorted((r["start"], r["doc_id"], r["shard"]) for r in tokens.read_documents(spark, folder).collect())

    without, beside = read(rows), read([*rows, (None, "")])
    assert [d for _, d, _ in without] == ids and [d for _, d, _ in beside] == [None, *ids]
    assert len({s for *_, s in beside}) >= len({s for *_, s in without}) > 4


def test_chat_query_reads_the_given_turn(spark, tables):
    rows = [(4, 0, "user", "hi"), (4, 1, "assistant", None)]
    folder = tables(conversations=spark.createDataFrame(rows, TURNS))
    got = {r["conv_id"]: r for r in queries.QUERIES["op1_chat_format"](spark, folder).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (got[4]["n_turns"], got[4]["loss_chars"]) == (2, 0)
