from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longtake.operators import chains, percentiles
from longtake.operators.ordered import neighbours, numbered, running
from longtake.session import stage


@pytest.fixture(scope="module")
def table(spark):
    """One key holds most of the rows."""
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 400), ("a", 9), ("b", 1), ("c", 40)):
        for i in range(n):
            rows.append((key, i * 3 + rng.randint(0, 2), rng.choice([None, rng.randint(-5, 9)])))
    rng.shuffle(rows)
    return stage(spark.createDataFrame(rows, "key string, pos long, v long")), pd.DataFrame(
        rows, columns=["key", "pos", "v"]
    ).sort_values(["key", "pos"], ignore_index=True)


def block():
    return F.floor(F.col("pos") / 10)


@pytest.mark.parametrize("exclusive", [False, True])
def test_running(table, exclusive):
    df, pdf = table
    got = running(
        df, ["key"], ["pos"], block(),
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))},
        exclusive=exclusive,
    ).toPandas().sort_values(["key", "pos"], ignore_index=True)
    for _, group in pdf.groupby("key"):
        values = group["v"].tolist()
        for i, row in enumerate(got.loc[group.index].itertuples()):
            seen = [x for x in values[: i + (not exclusive)] if not pd.isna(x)]
            want = (sum(seen), max(seen), seen[-1]) if seen else (None, None, None)
            have = tuple(None if pd.isna(x) else x for x in (row.s, row.m, row.l))
            assert have == want


def test_neighbours_and_numbers(table):
    df, pdf = table
    got = neighbours(df, ["key"], ["pos"], block(), before={"p": F.col("pos")}, after={"n": F.col("pos")})
    got = got.toPandas().sort_values(["key", "pos"], ignore_index=True)
    by = pdf.groupby("key")["pos"]
    assert got["p"].fillna(-1).tolist() == by.shift(1).fillna(-1).tolist()
    assert got["n"].fillna(-1).tolist() == by.shift(-1).fillna(-1).tolist()
    no = numbered(df, ["key"], ["pos"], block(), "i").toPandas().sort_values(["key", "pos"])
    assert no["i"].tolist() == pdf.groupby("key").cumcount().tolist()


@pytest.mark.parametrize("blocks", [1, 2, 32])
def test_percentiles(spark, monkeypatch, blocks):
    """The number of blocks changes no result."""
    monkeypatch.setattr(percentiles, "BLOCKS", blocks)
    rng = np.random.default_rng(1)
    data = {"hot": rng.normal(size=3000), "same": np.full(900, 2.5), "steps": rng.integers(0, 7, 2000) * 1.0}
    data |= {"one": np.array([4.0]), "two": np.array([1.0, 2.0]), "eleven": rng.normal(size=11)}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("hot", None)]
    df = stage(spark.createDataFrame(rows, "key string, v double"))
    wanted = {"p10": (0.1, "nearest"), "p95": (0.95, "nearest"), "l10": (0.1, "linear"), "l95": (0.95, "linear"), "top": (1.0, "nearest")}
    for row in percentiles.exact_percentiles(df, ["key"], F.col("v"), wanted).collect():
        values = np.sort(data[row.key])
        for name, (f, kind) in wanted.items():
            if kind == "nearest":
                assert row[name] == values[max(0, int(np.ceil(f * len(values))) - 1)]
            else:
                assert row[name] == pytest.approx(np.quantile(values, f), abs=1e-12)


@pytest.mark.parametrize("levels", [(), (8,), (4, 32), (3, 12, 60)])
def test_follow(spark, levels):
    rng = random.Random(5)
    rows, want = [], set()
    for key, n in (("hot", 300), ("x", 7), ("y", 1)):
        nxt = [i + rng.randint(1, 6) for i in range(n)]
        nxt = [j if j < n else chains.END for j in nxt]
        rows += [(key, i, nxt[i]) for i in range(n)]
        at = 0
        while at != chains.END:
            want.add((key, at))
            at = nxt[at]
    links = stage(spark.createDataFrame(rows, "key string, pos long, nxt long"))
    got = {(r.key, r.pos) for r in chains.follow(links, ["key"], 299, levels).collect()}
    assert got == want
