"""Quality rules, mixing, sharding and the classifier."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from longtake.llm import mixing, quality_model, rules, shards


def counts_of(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(again),
    )


def test_counts_against_plain_python(spark, documents):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "\t", "#", "é", " ", "|"], k=rng.randint(0, 90))) for _ in range(80)]
    texts += [None, "", " \n ", "x y z " * 4_000, "a\na\n\na\r\na"]
    got = rules.with_counts(documents(list(enumerate(texts)), extra=True)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in rules.COUNTS) for r in got] == [counts_of(t) for t in texts]


def test_buckets_are_close_and_ordered(spark):
    rows = spark.range(0, 5_000).select("id", rules.bucket(rules.F.col("id")).alias("b")).orderBy("id").collect()
    assert all(r["b"] <= r["id"] <= r["b"] * 1.125 for r in rows)
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def test_rules_keep_clean_and_reject_junk(spark, documents):
    rng = random.Random(3)
    clean = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(80))
    rows = [(i, clean(), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i in range(120)]
    rows += [(200, clean().replace(" ", "### "), "en", "s1"), (201, "few words", "en", "s1"), (202, None, None, None), (None, clean(), "en", "s9")]
    docs = documents(rows, extra=True)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(120), None}
    rated = {r["doc_id"]: r for r in rules.rated(docs).collect()}
    assert rated[201]["base_failed"] and rated[202]["base_failed"] and not rated[200]["base_failed"] and not rated[200]["kept"]
    assert rules.keep(documents([])).count() == 0


def test_limits_follow_the_habits_of_a_language(spark, documents):
    rng = random.Random(4)
    word = lambda longest: "".join(rng.choices("abcdefgh", k=rng.randint(2, longest)))
    text = lambda longest: " ".join(word(longest) for _ in range(80))
    rows = [(i, text(6), "short", "s") for i in range(300)]
    rows += [(1_000 + i, text(6 if i % 2 else 22), "long", "s") for i in range(300)]
    rows += [(2_000, text(24), "short", "s"), (2_001, text(24), "long", "s")]
    rated = {r["doc_id"]: r for r in rules.rated(documents(rows)).collect()}
    assert rated[0]["limit_word_length"] < rated[1_000]["limit_word_length"]
    assert not rated[2_000]["kept"] and rated[2_001]["kept"]
    assert all(r["kept"] for i, r in rated.items() if i < 2_000)


def test_limits_do_not_jump_with_the_number_of_documents(spark):
    def limit(n):
        rows = [("en", "big", "symbols", 0, 5_000), ("en", "small", "symbols", 0, n - n // 4), ("en", "small", "symbols", 64, n // 4)]
        sketch = spark.createDataFrame(rows, "lang string, source string, measure string, bucket long, n long")
        return next(r["limit_symbols"] for r in rules.fences(sketch).collect() if r["source"] == "small")

    few, *near, many = [limit(n) for n in (8, 100, 101, 102, 40_000)]
    assert few < near[0] < many and max(near) - min(near) <= 3
    assert many <= 64 + 4 * 64 + 80


def test_mix_keeps_columns_called_like_its_own(spark, documents):
    docs = documents([(i, "a b c", "en", f"s{i % 2}") for i in range(20)], extra=True)
    docs = docs.selectExpr("*", "'t' AS target", "'u' AS source_size")
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    assert {(r["size"], r["copies"], r["target"], r["source_size"]) for r in mixed.collect()} == {("x", "y", "t", "u")}
    assert mixing.mix(documents([])).count() == 0


def shared_out(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("case", range(4))
def test_targets_against_repeated_sharing(spark, case):
    rng = random.Random(case)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randint(1, 12))} | {None: 7}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = shared_out(sizes)
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_mix_emits_what_it_plans(spark, documents):
    rows = [(i, "w " * (i % 7), "en", f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(None, "a b", "en", "s1"), (5, None, "en", "s2")]
    docs = documents(rows, extra=True)
    plan = mixing.mix_plan(docs).collect()
    assert {(r["doc_id"], r["copies"]) for r in plan} == {(r["doc_id"], r["copies"]) for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert all(0 <= r["copies"] <= 2 for r in plan) and len(plan) == len(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    for source in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 0.35 * mine[0]["target"] + 12
    assert mixing.mix(documents([])).count() == 0


def test_shards_are_exact_and_reruns_agree(spark, documents):
    rows = [(i, f"text {i % 50}") for i in range(1_003)] + [(None, None)] * 4 + [(5, "text 5")] * 3
    for rows_per_part in (20_000, 20):
        docs = documents(rows, extra=True)
        got = shards.shard(docs, 24, rows_per_part=rows_per_part).collect()
        again = shards.shard(docs.repartition(5), 24, rows_per_part=rows_per_part).collect()
        place = lambda rows: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["shard"], r["slot"]) for r in rows)
        assert place(got) == place(again)
        sizes = Counter(r["shard"] for r in got)
        assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
        for s in range(24):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert shards.shard(documents([]), 24).count() == 0
    assert shards.shard(documents([(1, "a")]), 24).count() == 1


def test_matrix_has_exact_margins_and_the_right_spread():
    for counts in ([0, 10, 3, 0, 87], [1], [], [5_000] * 8):
        m = shards.communication_matrix(counts, 24, 1)
        assert [sum(r) for r in m] == counts
        columns = [sum(r[j] for r in m) for j in range(24)]
        assert max(columns) - min(columns) <= 1
    rng = np.random.default_rng(1)
    small = [shards._taken(rng, 40_000, 60_000, 500) for _ in range(4_000)]
    limit, shards.LARGEST_FOR_NUMPY = shards.LARGEST_FOR_NUMPY, 10
    try:
        own = [shards._taken(rng, 40_000, 60_000, 500) for _ in range(4_000)]
        assert all(max(0, n - b) <= shards._taken(rng, g, b, n) <= min(n, g) for g, b, n in [(0, 5, 3), (5, 0, 3), (2, 3, 5), (7, 9, 0)])
    finally:
        shards.LARGEST_FOR_NUMPY = limit
    assert abs(np.mean(small) - np.mean(own)) < 1 and abs(np.std(small) - np.std(own)) < 1


def test_classifier_on_held_out_rows(spark, documents):
    rng = random.Random(8)
    good, bad = [f"w{i}" for i in range(300)], [f"W{i}!!" for i in range(300)]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=60))) for i in range(900)] + [(None, "w1 w2"), (2_000, None), (2_001, ""), (7, "w1")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(900)] + [(None, 1, 0), (3, None, 0), (3, 0, 0)]
    docs = documents(rows, extra=True)
    weights = quality_model.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality_model.score(docs, weights).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    tested = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([(r["score"] > 0.5) == (r["doc_id"] % 3 > 0) for r in tested]) > 0.98
    same = quality_model.train(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (same == weights).all()
    none = quality_model.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not none.any()
