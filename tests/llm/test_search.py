"""Hard negatives, ranked search and nearest vectors against plain versions."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longtake.llm import blocks, hard_negatives, lexical, nearest, queries

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string, part string, dim int, payload string, asks int"


@pytest.fixture()
def vectors(spark):
    def make(rows):
        """(vec_id, vector, label) with columns of names that the operators use themselves."""
        return spark.createDataFrame([(*r, "r", "s", "p", 1, "x", 2) for r in rows], VECTORS)

    return make


def _odd(nan=float("nan"), inf=float("inf")):
    return [
        (None, [1.0, 0.5], 1), (20, None, 1), (40, [], 1), (60, [nan, 1.0], 1), (80, [inf, 1.0], 1), (100, [None, 1.0], 1),
        (120, [0.0, 0.0], 1), (140, [0.25, 0.5], None), (200, [1.0, -1.0, 0.5], 2), (201, [0.5, 0.5, 0.5], 2), (203, [0.5, -0.5, 0.5], 1),
    ]


def _some(n, dim, seed, copies=0):
    draw = np.random.default_rng(seed)
    made = [(i, np.float32(draw.standard_normal(dim)).tolist(), int(draw.integers(0, 4))) for i in range(n)]
    return made + [(1000 + i, made[0][1], made[0][2]) for i in range(copies)]


def _able(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def plain_nearest(rows, k):
    use = [(i, v) for i, v, _ in rows if i is not None and _able(v) and any(v)]
    out = []
    for q, a in use:
        if q % 20:
            continue
        scored = []
        for i, b in use:
            if i != q and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += x * y
                scored.append((-total, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def plain_negatives(rows, positives=5, negatives=10):
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and _able(v):
            use.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for anchor, a, label in use:
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i, other) for i, b, other in use if len(a) == len(b))
        good = [(-s, i) for s, i, other in scored if other == label and i != anchor][:positives]
        for p, positive in good:
            fit = [(-s, i) for s, i, other in scored if other != label and 30 * p <= 100 * -s <= 90 * p]
            out += [(anchor, positive, r, i, p, s) for r, (s, i) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def _nearest(df, k=20):
    found = nearest.nearest(df, F.col("vec_id") % 20 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def _mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label).collect()))


@pytest.mark.parametrize("dim", [3, 17, 130])
def test_vectors_against_plain(spark, vectors, monkeypatch, dim):
    monkeypatch.setattr(blocks, "TILE_ROWS", 50)
    rows = _some(420, dim, dim, copies=90) + _odd()
    df = vectors(rows).repartition(5)
    assert _nearest(df) == plain_nearest(rows, 20)
    assert _mined(df) == plain_negatives(rows)


def test_small_blocks_ties_and_repeated_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 10)
    cut = blocks.query_blocks
    for module in (nearest, hard_negatives):
        monkeypatch.setattr(module, "query_blocks", lambda q, e, v: cut(q, e, v, 3))
    rows = [(i % 300, [float(i % 3), 1.0, float(i % 2)], i % 2) for i in range(600)]
    assert _nearest(vectors(rows), 7) == plain_nearest(rows, 7)
    assert _mined(vectors(rows)) == plain_negatives(rows)


def test_no_vectors(spark, vectors):
    for rows in ([], _odd()[:7], [(20, [1.0], 1)]):
        assert _nearest(vectors(rows)) == plain_nearest(rows, 20)
        assert _mined(vectors(rows)) == plain_negatives(rows)


def test_large_numbers(spark):
    """Scores that single precision or the product of lengths cannot tell apart."""
    rows = [(20 * i, [1e200 * (i % 3), 1.0 + i * 1e-15], 1) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert _nearest(df, 3) == plain_nearest(rows, 3)
    rows = [(100 * i, [float(2**20 + i), float(i)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert _mined(df) == plain_negatives(rows)


def test_intervals_hold_every_score():
    draw = np.random.default_rng(3)
    for dim in (1, 8, 64, 200):
        x = np.concatenate([draw.standard_normal((60, dim)), np.zeros((1, dim)), np.eye(1, dim), -np.eye(1, dim)])
        others = {"vec_id": np.arange(len(x)), "label": np.zeros(len(x))}
        anchors, rows = hard_negatives.encode_anchors(x, others), hard_negatives.encode_rows(x, others)
        lower, upper = hard_negatives.intervals(anchors, rows)
        true = rows["v"].astype(np.int64) @ rows["v"].astype(np.int64).T
        assert (lower <= true).all() and (true <= upper).all()
        if dim == 64:
            assert (upper - lower < 0.9 * 2 * np.outer(anchors["norm"], rows["norm"])).mean() > 0.9  # not only |cos| <= 1


def test_tiles_leave_few_pairs():
    x = np.random.default_rng(5).standard_normal((3000, 64)).astype(np.float32)
    solver, kept = nearest.NearestSolver(20), []
    solver.open({"ids": np.arange(100), **nearest.quantise(x[:100])})
    keep = solver._keep
    solver._keep = lambda r, c, v: (kept.append(len(r)), keep(r, c, v))
    for at in range(0, 3000, 500):
        solver.step({"ids": np.arange(at, at + 500), **nearest.quantise(x[at : at + 500])})
    assert sum(kept) < 0.05 * 100 * 3000


# Ranked search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_rank(docs, items, k=50):
    split = [(i, plain_terms(t)) for i, t in docs]
    n_docs, words = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    df = {}
    for _, found in split:
        for term in set(found):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(plain_terms(text)) if t in df}
        scored = []
        for doc, found in split:
            score = 0
            for t, w in weights.items():
                if tf := found.count(t):
                    m = 100 - 50 + (50 * len(found) * n_docs) // words
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        if item is not None:
            out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def _texts(n, seed, vocabulary=60):
    draw = random.Random(seed)
    word = lambda: f"W{min(int(draw.expovariate(0.08)), vocabulary)}"
    return [(i, " ".join(word() for _ in range(draw.randint(0, 40)))) for i in range(n)]


def _tables(spark, docs, items):
    left = spark.createDataFrame([(*d, "t", 1, 2) for d in docs], "doc_id long, text string, term string, row long, n long")
    right = spark.createDataFrame([(*i, "t", 1) for i in items], "item_id long, text string, term string, rank int")
    return left, right


def _ranked(spark, docs, items, k=50, **sizes):
    found = lexical.rank(*_tables(spark, docs, items), k, **sizes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()))


ODD_TEXTS = [
    (None, "w1 w2"), (900, None), (901, ""), (902, " ,;\t\x00\x7f"), (903, "Ünï w1 w2 日本 w1"), (904, "w5 " * 30_000), (2**60 + 1, "w3 w9"),
    (905, "w3-w9.W3"), (905, "w3-w9.W3"), (905, "w4"),
]


@pytest.mark.parametrize("sizes", [{}, {"part_postings": 300, "part_queries": 40}])
def test_rank_against_plain(spark, sizes):
    docs = _texts(400, 1) + ODD_TEXTS
    items = _texts(25, 2) + [(None, "w1"), (70, None), (71, ""), (72, "absent"), (73, "Ünï 日本"), (74, "w1 w1 W1"), (74, "w7"), (75, "w0 w0w1")]
    assert _ranked(spark, docs, items, 10, **sizes) == plain_rank(docs, items, 10)
    assert _ranked(spark, docs, items, 50, **sizes) == plain_rank(docs, items, 50)


def test_rank_ties_go_to_smaller_ids(spark):
    docs = [(i * 37 % 500, "same words here") for i in range(500)] + [(600, "other")] * 3
    items = [(1, "same words"), (2, "other"), (3, "here other")]
    assert _ranked(spark, docs, items, part_postings=64) == plain_rank(docs, items)


def test_rank_of_nothing(spark):
    docs, items = _texts(5, 3), _texts(3, 4)
    for left, right in (([], items), (docs, []), ([], []), ([(1, None)], items), (docs, [(1, None)])):
        assert _ranked(spark, left, right) == plain_rank(left, right)


def test_term_is_the_same_bytes():
    for text in ("Ab-cD_9`z{Z", "\x00a\x1fb\x7fc", "ß É x", "Éİi"):
        assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


def test_best_positions_stop_early_and_never_too_early():
    draw = np.random.default_rng(9)
    for trial in range(30):
        n, lists = 3000, []
        for t in range(4):
            rows = np.flatnonzero(draw.random(n) < 0.5)
            high = 40 if trial % 2 else 10**6  # many ties, or hardly any
            lists.append(pd.DataFrame({"term": f"t{t}", "row": rows, "doc_id": n - rows, "impact": draw.integers(1, high, len(rows))}))
        part = lexical.Part(pd.concat(lists))
        weights = {f"t{t}": int(draw.integers(0, 50)) for t in range(4)} | {"none": 5}
        docs, values, looked = part.search(weights, 10)
        scores = np.zeros(n + 1, np.int64)
        for t, rows in enumerate(lists):
            np.add.at(scores, rows["doc_id"].to_numpy(), rows["impact"].to_numpy() * weights[f"t{t}"])
        order = np.lexsort((np.arange(n + 1), -scores))[:10]
        assert part.ids[docs].tolist() == order.tolist() and values.tolist() == scores[order].tolist()
        if not trial % 2:
            assert looked < 0.8 * n


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_ranked_search", "op13_nearest_vectors"])
def test_columns(spark, tables, vectors, name):
    docs, items = _tables(spark, _texts(20, 5), _texts(3, 6))
    folder = tables(embeddings=vectors(_some(120, 4, 1)), documents=docs, benchmark=items)
    types = dict(queries.QUERIES[name](spark, folder).dtypes)
    assert types["rank"] == "int" and {v for k, v in types.items() if k.endswith("_id")} == {"bigint"}
    assert all(v == ("double" if name.startswith("op13") else "bigint") for k, v in types.items() if k.endswith("score"))
