"""Every stage of the pipeline on its own input, and the whole, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
from test_copies import plain_classes, words
from test_selection import counts_of, shared_out

import corpus_pipeline
from longtake.llm import decontaminate, queries


def draw(doc_id):
    return int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def test_stages_and_run(spark, documents, tables):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 20, 9_000))) for i in range(5)]
    rows = [(i, " ".join(words(rng, 60 + i % 40, 5_000)), "en", f"s{i % 4}") for i in range(90)]
    rows += [(200 + i, rows[i][1] if i % 2 else rows[i][1] + " tail", "en", "s1") for i in range(12)]
    rows += [(300 + i, rows[40 + i][1] + " " + items[i][1], "en", "s2") for i in range(5)]
    rows += [(400, "too short", "en", "s0"), (401, None, "en", None), (402, "again and again " * 40, "en", "s0")]
    docs = documents(rows)
    folder = tables(documents=docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    now, kept = docs, []
    for _, step in corpus_pipeline.STAGES:
        now = step(spark, now, folder)
        kept.append(sorted(tuple(r) for r in now.collect()))
    as_rows = lambda ids: sorted(tuple(r) for r in docs.collect() if r["doc_id"] in ids)

    failed = {r[0] for r in rows if (c := counts_of(r[1]))[0] < 50 or 2 * c[4] > c[0]}
    left = {r[0]: r[1] for r in rows if r[0] not in failed}
    assert kept[0] == as_rows(left)
    classes = plain_classes(list(left.items()))
    left = {d: t for d, t in left.items() if classes[d] == d}
    assert kept[1] == as_rows(left) and not any(200 <= d < 300 for d in left)
    flat = lambda t: " ".join(decontaminate.terms_of(t))
    left = {d: t for d, t in left.items() if not any(flat(i) in flat(t) for _, i in items)}
    assert kept[2] == as_rows(left) and not any(d >= 300 for d in left)
    source = {r[0]: r[3] for r in rows}
    sizes: dict = {}
    for d, t in left.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(t.split())
    target = shared_out(sizes)
    mixed = []
    for d in sorted(left):
        rate = target[source[d]] / sizes[source[d]]
        mixed += [d] * (math.floor(rate) + (draw(d) < rate - math.floor(rate)))
    assert [r[0] for r in kept[3]] == mixed
    library, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d in mixed:
        ids = library.encode(left[d], add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert kept[4] == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_an_empty_table_passes_all_stages(spark, documents, tables):
    folder = tables(documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
