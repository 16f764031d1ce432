"""Near copies, repeated passages, leaks and personal data against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longtake.llm import decontaminate, near, privacy, substrings


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Near copies


def labels_of(text, width=5):
    w = (text or "").encode().split()
    n = min(width, len(w))
    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []
    seen, out = defaultdict(int), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def in_order_similarity(a, b):
    a, b = labels_of(a), labels_of(b)
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j + 1], 0, row[j] + (x == y)) for j, y in enumerate(b)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1]) if a or b else 1.0


def plain_classes(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    text = {d: t or "" for d, t in sorted(rows, key=lambda r: r[1] or "", reverse=True) if d is not None}
    top = {d: d for d in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (text[a] == text[b] or in_order_similarity(text[a], text[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d in ids}


def test_near_copies_against_all_pairs(spark, documents):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        w = words(rng, 60 + 10 * base)
        rows.append((base * 10, " ".join(w)))
        for k in range(1, 6):
            edited = w.copy()
            for _ in range(k - 1):
                edited[rng.randrange(len(w))] = "new"
            rows.append((base * 10 + k, " ".join(edited)))
    rows += [(500, "one two"), (501, "one two"), (502, "one  two"), (503, None), (504, ""), (505, "a a a a a a a a a a a a"), (506, "a a a a a a a a a a a")]
    docs = documents([*rows, (None, "one two"), (None, "nowhere else"), (500, "one two")], extra=True)
    got = near.classes(docs).collect()
    assert len(got) == len(rows) + 3
    want = plain_classes(rows)
    want[502] = 500  # the same words between other spaces
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert sorted((r["class_id"] is None, r["n_copies"]) for r in got if r["doc_id"] is None) == [(False, 4), (True, 1)]
    kept = near.first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((False, d) for d, c in want.items() if d == c) + [(True, 0)]
    assert near.classes(documents([])).count() == 0 and near.first_of_class(documents([])).count() == 0


def test_one_original_with_many_different_copies(spark, documents):
    """Copies that are near to the original only; the original is not the smallest id."""
    rng = random.Random(9)
    w = words(rng, 200, 5_000)
    rows = [(999, " ".join(w))]
    for k in range(40):
        copy = w.copy()
        for j in range(3):
            copy[5 * k % 195 + j * 2] = f"n{k}.{j}"
        rows.append((k, " ".join(copy)))
    got = {r["class_id"] for r in near.classes(documents(rows)).collect()}
    assert got == {0}


def test_texts_that_share_an_id_are_told_apart(spark, documents):
    rng = random.Random(14)
    base = [words(rng, 80, 5_000) for _ in range(3)]
    text = [" ".join(w) for w in base]
    near_to = [" ".join(edited(w, {40: "new"})) for w in base]
    rows = [(1, text[0]), (1, text[1]), (2, near_to[0]), (3, near_to[1]), (None, text[2]), (None, near_to[2]), (None, near_to[0]), (1, text[0])]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_copies"]) for r in near.classes(documents(rows)).collect())
    assert got == [(0, 0, 1), (0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1)]
    kept = [(r["doc_id"], r["text"]) for r in near.first_of_class(documents(rows, extra=True)).collect()]
    assert len(kept) == 3 and {(1, text[0]), (1, text[1])} <= set(kept)
    assert sum(d is None and t in (text[2], near_to[2]) for d, t in kept) == 1


ONE_SKETCH = near.Near(kept=0, sketches=1)  # every text shares it


def edited(w, places):
    copy = w.copy()
    for at, word in places.items():
        copy[at] = word
    return copy


def test_a_star_of_more_texts_than_a_task_takes(spark, documents):
    """Copies are near to the original only, all meet in one sketch, and the original is not the smallest id."""
    rng = random.Random(10)
    w = words(rng, 200, 5_000)
    rows = [(9_999, " ".join(w))]
    for k in range(2_100):
        rows.append((k, " ".join(edited(w, {5 * at: f"n{k}.{at}" for at in rng.sample(range(40), 4)}))))
    assert {r["class_id"] for r in near.classes(documents(rows), ONE_SKETCH).collect()} == {0}


def test_partners_behind_many_that_look_more_alike(spark, documents):
    """Rotated texts have the signature of the text, but not its order; the true partner comes after them."""
    w = words(random.Random(11), 200, 5_000)
    v = edited(w, {40 * k + 20: f"new{k}" for k in range(4)})
    rows = [(0, " ".join(words(random.Random(12), 200, 5_000)))]
    for d, k in enumerate((0, 40, 70, 100, 130, 160)):
        rows += [(10 + d, " ".join(w[k:] + w[:k])), (20 + d, " ".join(v[k:] + v[:k]))]
    want = plain_classes(rows)
    assert want[20] == 10
    assert {r["doc_id"]: r["class_id"] for r in near.classes(documents(rows), ONE_SKETCH).collect()} == want


def test_alignment_counts_order():
    many = near.mixed(np.arange(1, 101, dtype=np.uint64))
    s = near.Near()
    assert near.shared_in_order(many, many, s) == 100
    assert near.shared_in_order(many, np.concatenate([many[3:], many[:3]]), s) == 97
    assert near.shared_in_order(many, np.concatenate([many[50:], many[:50]]), s) == 0
    assert near.shared_in_order(many, many[:79], s) == 0 and near.shared_in_order(many, many[:80], s) == 80
    assert near.shared_in_order(many[:0], many, s) == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 200)]
    got = {r["id"]: r["label"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


# Repeated passages


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 13))
def test_window_names_depend_on_their_words_alone(sequence, width):
    if len(sequence) < width:
        return
    named = near.mixed(np.arange(1, 5, dtype=np.uint64))[np.asarray(sequence)]
    names = substrings.window_names(named, np.arange(len(sequence) - width + 1), width).tolist()
    windows = [tuple(sequence[i : i + width]) for i in range(len(names))]
    assert len(set(zip(windows, names, strict=True))) == len(set(windows)) == len(set(names))


@pytest.mark.parametrize("n", [0, 1, 999])
def test_packed_names_come_back(n):
    names = np.unique(near.mixed(np.arange(n, dtype=np.uint64)))
    assert (substrings.unpack_names(substrings.pack_names(names), n) == names).all()


def plain_removal(rows, width):
    rank = lambda d: (d is not None, d or 0)
    first, split = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, rank(d)), rank(d))
    for d, w in split:
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < rank(d) for k in range(width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        yield (d, len(w), len(gone), b" ".join(kept).decode())


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 3_000])
def test_removal_against_plain_python(spark, documents, chunk_bytes):
    rng = random.Random(6)
    shared = words(rng, 60, 10_000)
    rows = []
    for d in range(60):
        a, n = rng.randrange(30), rng.randint(0, 30)
        rows.append((d * 3, " ".join(words(rng, rng.randint(0, 40)) + shared[a : a + n] + words(rng, 5) + ["run"] * rng.randint(0, 30))))
    rows += [(7, None), (8, ""), (None, " ".join(shared)), (None, " ".join(shared)), (400, " ".join(shared)), (400, " ".join(shared)), (401, "é\x1cü " * 15)]
    docs = documents(rows, extra=True)
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs, 13, chunk_bytes=chunk_bytes).collect()), key=key)
    assert got == sorted(plain_removal(rows, 13), key=key)
    assert substrings.remove_repeats(documents([])).count() == 0


# Leaks


def test_leaks_against_scoring_everything(spark, documents):
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, rng.randint(12, 40), 900)) + "?") for i in range(60)] + [(None, "no id"), (90, None), (91, "")]
    rows = [(d, " ".join(words(rng, rng.randint(0, 300), 900))) for d in range(80)]
    for d in range(100, 140):
        item = items[d % 60][1]
        rows.append((d, " ".join(words(rng, rng.randint(0, 150))) + " " + (item.upper() if d % 3 else item.replace(" ", " , ")) + " end"))
    rows += [(None, items[0][1]), (200, None), (201, "")]
    index = decontaminate.ItemIndex([i for i in items if i[0] is not None], decontaminate.Leaks())
    detector = decontaminate.Detector(index)
    for _, text in rows:
        for _, _, terms in detector.passages(decontaminate.terms_of(text)):
            score = defaultdict(float)
            for t in terms.tolist():
                for item, x in zip(index.docs[t], index.impacts[t], strict=True):
                    score[item] += x
            assert sorted(i for i, _ in index.search(terms)) == sorted(i for i, s in score.items() if s >= 0.6)
    docs = documents(rows, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked(docs, bench).collect()}
    flat = lambda t: " ".join(decontaminate.terms_of(t))
    assert got == {(d, i) for d, t in rows for i, x in items if i is not None and flat(x) and flat(x) in flat(t)}
    small = decontaminate.Leaks(items_per_index=7)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked(docs, bench, small).collect()} == got
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, _ in got})
    assert decontaminate.leaked(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and privacy.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a_@.1 +-%(5A\n0é", max_size=50), st.text("0123456789 -.+", max_size=90)))
def test_base_spans_against_the_patterns(text):
    assert privacy.base_spans(text) == plain_spans(text)


def test_luhn():
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112")


def test_terms_that_give_an_entity_away(spark, documents):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 30)) + " common name") for i in range(100)]
    for i in range(200, 204):
        rows.append((i, f"the secretname common writes to x.y@mail.example now {i}"))
    rows += [(300, "only once uniquename a@b.cd"), (None, "secretname x.y@mail.example"), (301, None), (302, "")]
    docs = documents(rows, extra=True)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in privacy.personal_data(docs).collect()}
    assert len(got) == len(rows)
    text = rows[100][1]
    a = text.index("secretname")
    assert ("removed", a, a + 10) in got[200] and ("email", text.index("x.y"), text.index("x.y") + 16) in got[200]
    b = text.index("common")
    assert not any(s == b for _, s, _ in got[200])  # as frequent without the entity
    assert [k for k, _, _ in got[300]] == ["email"] and got[301] == got[302] == [] and got[5] == []
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(documents([*rows, (5, rows[5][1])], extra=True)).collect()}
    assert "secretname" not in clean[None] and "[EMAIL]" in clean[None]
    assert "secretname" not in clean[200] and "[EMAIL]" in clean[200] and clean[301] is None and clean[5] == rows[5][1]
    assert privacy.personal_data(documents([])).count() == 0


def test_terms_far_from_their_entity(spark, documents):
    """Terms count over the whole text of an entity, and are marked wherever they occur in it."""
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30)) + " common") for i in range(100)]
    text = "secretname x.y@mail.example " + "common " * 30 + "distantname and Secretname"
    rows += [(200 + i, text) for i in range(3)] + [(210, text + " other end")]
    got = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] for r in privacy.personal_data(documents(rows)).collect()}
    marked = [("removed", "secretname"), ("email", "x.y@mail.example"), ("removed", "distantname"), ("removed", "and"), ("removed", "Secretname")]
    assert got[200] == got[202] == marked and got[0] == []


def plain_disclosing(texts, support=2, remove_at=0.95, generalise_at=0.8):
    """(entity, term) -> kind over the different texts, by the definition."""
    texts = sorted({t or "" for t in texts})
    entities, terms = [], []
    for text in texts:
        spans = privacy.base_spans(text)
        entities.append({privacy._entity(k, text[a:b]) for k, a, b in spans})
        terms.append(({w for w, _, _ in privacy.terms_outside(text, spans)}, {w.lower() for w in privacy._TERM.findall(text)}))
    out = {}
    for entity in set().union(*entities):
        holders = [i for i, e in enumerate(entities) if entity in e]
        for term in set().union(*(terms[i][0] for i in holders)):
            both = sum(term in terms[i][0] for i in holders)
            with_term = sum(term in t[1] for t in terms)
            content = math.log2(len(texts) / len(holders))
            told = math.log2(both * len(texts) / (len(holders) * with_term)) / content if content > 0 else 0.0
            if both >= support and told >= generalise_at:
                out[entity, term] = "removed" if told >= remove_at else "generalised"
    return out


def test_disclosing_terms_against_plain_counts(spark, documents):
    rng, rows = random.Random(4), []
    for i in range(300):
        who = rng.randint(0, 40)
        near = f" Name{who} alias{who % 7} İzmirli{who} writes to p{who}@mail.example" if i % 3 == 0 else f" alias{who} p.{who}"
        rows.append((i, " ".join(words(rng, 12)) + near.replace("0", "o").replace("1", "i")))
    rows += [(600 + i, f"teamword {words(rng, 3)} " + ("asks team@mail.example" if i < 10 else "asks nobody")) for i in range(15)]
    rows += [(400 + i, rows[3 * (i % 20)][1]) for i in range(60)] + [(500, None), (501, "")]
    docs = documents(rows)
    found = privacy._scanned(docs)
    got = {(r["entity"], r["term"]): r["kind"] for r in privacy.disclosing_terms(docs, found).collect()}
    assert got == plain_disclosing([t for _, t in rows]) and set(got.values()) == {"removed", "generalised"}


def test_copies_are_one_witness(spark, documents):
    text = "rareword and others write to x.y@mail.example"
    rows = [(i, "plain words " + str(i)) for i in range(50)] + [(100 + i, text) for i in range(40)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in privacy.personal_data(documents(rows)).collect()}
    assert got[100] == got[139] == ["email"]


def test_one_way_of_lowering(spark, documents):
    rows = [(i, f"plain words {i}") for i in range(60)] + [(100 + i, f"İzmirli x.y@mail.example number {i}") for i in range(3)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in privacy.personal_data(documents(rows)).collect()}
    assert got[100] == ["removed", "email", "removed"]
