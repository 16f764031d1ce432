"""Near-duplicates by order MinHash; candidates are verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import bare, exclusive_sums

MEMO_WORDS, MEMO_LETTERS = 200_000, 64
SIGNATURE = 64
SALTS = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Near:
    """Shingles of ``width`` words; ``kept`` of them per sketch, in text order; ``sketches`` sketches.

    Two texts are near if the shingles they share in order are at least ``least`` / ``least_of`` of
    all their shingles together. At that border two texts agree in one sketch in about half of all
    cases, so all ``sketches`` miss with probability 2 to their negative.
    """

    width: int = 5
    kept: int = 3
    sketches: int = 14
    least: int = 4
    least_of: int = 5
    screen: float = 0.4
    together: int = 2_000
    together_labels: int = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingles of a text, each labelled with how often it came before, so that no label repeats."""

    def __init__(self, width: int):
        self.width = width
        self.memo: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Labels in text order; a text with fewer words than a shingle is one shingle."""
        words = bare(text)
        if not words:
            return np.zeros(0, np.uint64)
        memo, slow = self.memo, self._word
        h = np.fromiter((memo.get(w) or slow(w) for w in words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        s = np.zeros(n, np.uint64)
        for j in range(width):
            s = mixed(s + h[j : j + n] + _A)
        order = np.argsort(s, kind="stable")
        first = np.concatenate([[True], s[order][1:] != s[order][:-1]])
        if first.all():
            return s
        at = np.arange(n)
        number = np.empty(n, np.uint64)
        number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        return np.where(number > 0, mixed(s + number * _A), s)


def order_sketches(labels: np.ndarray, settings: Near) -> np.ndarray:
    """Per sketch the smallest labels under its own order, in text order, as one number."""
    if not len(labels):
        return np.zeros(0, np.int64)
    seeds = mixed(np.arange(1, settings.sketches + 1, dtype=np.uint64) * _A)
    ranks = mixed(labels[None, :] ^ seeds[:, None])
    kept = min(settings.kept, len(labels))
    found = np.argpartition(ranks, kept - 1, axis=1)[:, :kept] if kept < len(labels) else np.tile(np.arange(kept), (len(seeds), 1))
    found.sort(axis=1)
    key = seeds.copy()
    for j in range(kept):
        key = mixed(key + labels[found[:, j]])
    return key.view(np.int64)


def signature(labels: np.ndarray) -> bytes:
    """One byte of the smallest label in each of ``SIGNATURE`` parts of the number range; 0 for none."""
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    scrambled = mixed(labels + _C)
    np.minimum.at(out, (scrambled >> np.uint64(58)).astype(np.int64), scrambled)
    return np.where(out == np.iinfo(np.uint64).max, 0, out % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def shared_in_order(a: np.ndarray, b: np.ndarray, settings: Near) -> int:
    """Labels that an alignment of both sequences can match, 0 where they cannot be near.

    Labels do not repeat, so the alignment is the longest increasing run of matched positions. Near
    texts leave few labels unmatched, which bounds how far matched positions lie apart: the band.
    """
    total = len(a) + len(b)
    need = -(-total * settings.least // (settings.least + settings.least_of))
    if not total or min(len(a), len(b)) < need:
        return 0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= total - 2 * need
    i, j = i[inside], j[inside]
    if len(i) < need:
        return 0
    path = j[np.argsort(i)]
    if (np.diff(path) > 0).all():
        return len(path)
    tails: list[int] = []
    for x in path.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails) if len(tails) >= need else 0


def verified(pairs: DataFrame, texts: DataFrame, settings: Near) -> DataFrame:
    """The pairs (a, b) whose texts are near; ``texts`` has one row (id, text) per id."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last, labels = Shingles(settings.width), None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last:  # rows of one b come together
                    last, labels = b, shingles.of(text_b)
                near.append(shared_in_order(shingles.of(text_a), labels, settings) > 0)
            yield batch.loc[near, ["a", "b"]]

    return stage(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(align, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the component of every id with an edge.

    Labels spread over edges and then jump to the label of their label, until none changes. Every
    step is written; only the number of changed labels comes to the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(spread, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        # The jump uses the labels before this step, which only lie higher.
        moved = stage(
            spread.join(above, "label", "left").select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        )
        labels = moved.select("id", "label")
        if moved.where("old != label").isEmpty():
            return labels


TASK = ["band", "key", "low", "high"]


def _untested(group: pd.DataFrame, settings: Near) -> Iterator[tuple[int, np.ndarray]]:
    """Per text its partners in this task that no other task holds it against, by row number.

    They are of another class, of a fitting length and alike by signature, and share no earlier
    sketch, where they would be met as well. Pairs with the first text of the sketch are known.
    """
    sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), SIGNATURE)
    keys = np.asarray(group["keys"].tolist(), np.int64)[:, : group["band"].iloc[0]]
    label, n, block = group["label"].to_numpy(), group["n"].to_numpy(), group["block"].to_numpy()
    free = (group["id"] != group["hub"]).to_numpy()
    low, high = group["low"].iloc[0], group["high"].iloc[0]
    at = np.arange(len(group))
    for x in np.flatnonzero(free & (block == low)).tolist():
        other = (at > x) if low == high else (block == high)
        short, long = np.minimum(n[x], n), np.maximum(n[x], n)
        fits = short * settings.least_of >= long * settings.least
        good = np.flatnonzero(other & free & (label != label[x]) & fits)
        if len(good):
            some = (sig[good] > 0) | (sig[x] > 0)
            alike = ((sig[good] == sig[x]) & some).sum(axis=1) / np.maximum(1, some.sum(axis=1))
            good = good[alike >= settings.screen]
            good = good[~(keys[good] == keys[x]).any(axis=1)]
            if len(good):
                yield x, good


def _links(group: pd.DataFrame, settings: Near) -> list[tuple[int, int]]:
    """Near pairs among the untested ones of a task; pairs that its links have joined are left out."""
    shingles, label = Shingles(settings.width), group["label"].tolist()
    labels = [shingles.of(t) for t in group["text"]]
    ends = np.cumsum([0, *map(len, labels)])
    names, codes = np.unique(np.concatenate(labels), return_inverse=True)
    mark, top = np.zeros(len(names), bool), {x: x for x in label}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    ids, found = group["id"].tolist(), []
    for x, good in _untested(group, settings):
        mine = codes[ends[x] : ends[x + 1]]
        mark[mine] = True
        for y in good.tolist():
            if find(label[x]) == find(label[y]):
                continue
            shared = np.count_nonzero(mark[codes[ends[y] : ends[y + 1]]])
            need = (len(labels[x]) + len(labels[y])) * settings.least
            if shared * (settings.least + settings.least_of) >= need and shared_in_order(labels[x], labels[y], settings):
                top[find(label[x])] = find(label[y])
                found.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
        mark[mine] = False
    return found


def _rest(grouped: DataFrame, labels: DataFrame, texts: DataFrame, bodies: DataFrame, settings: Near) -> DataFrame:
    """(a, b): what links the classes that still share a sketch, every pair of their texts held against each other.

    Texts of a sketch are dealt into blocks, those of its largest class apart, as they need not be
    held against each other; a task takes one or two blocks, and every pair of blocks has its task.
    Texts are fetched only for tasks and ids with an untested pair, so no table of pairs is made.
    """
    labelled = grouped.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = labelled.groupBy("band", "key", "label").agg(F.count("*").alias("texts"), F.sum("n").alias("of_texts"))
    several = sizes.groupBy("band", "key").agg(
        F.max(F.struct("texts", "of_texts", "label")).alias("main"), F.sum("texts").alias("texts"), F.sum("of_texts").alias("of_texts"),
        F.count("*").alias("classes"),
    ).where("classes > 1")

    def blocks(texts, of_texts):
        by_size = F.greatest(texts / (settings.together / 2), of_texts / (settings.together_labels / 2))
        return F.greatest(F.lit(1), F.ceil(by_size)).cast("int")

    main = F.col("main")
    several = several.select(
        "band", "key", main["label"].alias("main"),
        blocks(F.col("texts") - main["texts"], F.col("of_texts") - main["of_texts"]).alias("open_blocks"),
        blocks(main["texts"], main["of_texts"]).alias("main_blocks"),
    )
    deal = lambda n: F.pmod(F.xxhash64("id", "band", "key"), n).cast("int")
    inside = F.col("label") == F.col("main")
    dealt = labelled.join(several, ["band", "key"]).withColumn(
        "block", F.when(inside, F.col("open_blocks") + deal(F.col("main_blocks"))).otherwise(deal(F.col("open_blocks")))
    )
    tasks = F.sequence(F.lit(0), F.col("open_blocks") + F.when(inside, 0).otherwise(F.col("main_blocks")) - 1)
    dealt = dealt.withColumn("task", F.explode(tasks)).select(
        "band", "key", F.least("block", "task").alias("low"), F.greatest("block", "task").alias("high"), "block", "id", "hub", "n", "label"
    )
    dealt = dealt.join(texts.select("id", "sig", "keys"), "id").select(*TASK, "block", "id", "hub", "n", "label", "sig", "keys")

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(group), bool)
        for x, good in _untested(group, settings):
            hit[x] = hit[good] = True
        return group[hit]

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(np.asarray(_links(group, settings), np.int64).reshape(-1, 2), columns=["a", "b"])

    open_texts = stage(dealt.groupBy(*TASK).applyInPandas(screen, dealt.schema))
    return stage(open_texts.join(bodies, "id").groupBy(*TASK).applyInPandas(link, "a long, b long"))


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """Rows with ``same``, the digest of their text, and ``who``, their doc_id as text, empty for null."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("who")
    return docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("same"), who, *columns)


def _classified(docs: DataFrame, settings: Near) -> tuple[DataFrame, DataFrame]:
    """(same, doc_id) of every row, and (same, first_id, who, n_copies, id, label) of every different text.

    Texts are numbered by their smallest doc_id, null last, and digest; the number is ``id``, and
    ``label`` is the smallest number of the class.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(settings.width)
        for batch in batches:
            rows = []
            for same, doc_id, text in zip(batch["same"], batch["who"], batch["text"], strict=True):
                labels = shingles.of(text)
                rows.append((same, doc_id or None, len(labels), order_sketches(labels, settings), signature(labels)))
            yield pd.DataFrame(rows, columns=["same", "doc_id", "n", "keys", "sig"])

    rows = stage(
        _keyed(docs, "text")
        .mapInPandas(sketch, "same string, doc_id string, n int, keys array<long>, sig binary")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
    texts = stage(
        rows.groupBy("same").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"),
            F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"),
        )
    )
    numbers = exclusive_sums(texts.select("same", "first_id"), [F.col("first_id").asc_nulls_last(), "same"], {"id": F.lit(1)})
    texts = stage(texts.join(numbers.select("same", F.col("id").cast("long").alias("id")), "same"))
    members = texts.select("id", "n", F.posexplode("keys").alias("band", "key"))
    hubs = members.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    grouped = stage(members.join(hubs, ["band", "key"]))
    who = F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("who")
    wanted = texts.join(grouped.select("id").distinct(), "id").select("same", who, "id")
    bodies = _keyed(docs, "text").join(wanted, ["same", "who"])
    # Rows repeated as a whole are one text.
    bodies = bodies.withColumn("__n", F.row_number().over(Window.partitionBy("same", "who").orderBy("id"))).where("__n = 1")
    bodies = stage(bodies.select("id", "text"))
    lengths = members.select(F.col("id").alias("hub"), F.col("n").alias("hub_n")).distinct()
    pairs = grouped.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), "n").distinct()
    pairs = pairs.join(lengths, pairs["b"] == lengths["hub"])
    fits = F.least("n", "hub_n") * settings.least_of >= F.greatest("n", "hub_n") * settings.least
    edges = verified(pairs.where(fits).select("a", "b"), bodies, settings)
    more = _rest(grouped.where("size > 2"), components(edges), texts, bodies, settings)
    labels = components(edges.union(more))
    named = texts.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    return rows, stage(named.select("same", "first_id", who, "n_copies", "id", "label"))


def classes(docs: DataFrame, settings: Near = Near()) -> DataFrame:
    """(doc_id, class_id, n_copies): every row of ``docs`` with the smallest doc_id of its class.

    Equal texts (null as empty) are one text; n_copies counts its rows. Texts are linked if their
    word shingles agree in order (``Near``), and classes are the connected texts. Per sketch every
    text is held against the first text that shares it. Then every two texts that share a sketch but
    not their class are held against each other if their signatures are alike; sketches with more
    than ``together`` texts are dealt into blocks, and every pair of blocks is taken. Texts, not
    ids, are compared: rows without id and rows that share an id but not a text take part as any
    other. class_id is null where no row of a class has an id. Repeated rows are kept; other columns
    are ignored; an empty table gives no rows.
    """
    rows, texts = _classified(docs, settings)
    # One class may hold most texts, so its name is met in several places.
    heads = texts.where("id = label").select("label", F.col("first_id").alias("class_id"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = texts.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
    named = alone.join(heads, ["label", "salt"]).select("same", "class_id", "n_copies")
    return rows.select("doc_id", "same").join(stage(named), "same").select("doc_id", "class_id", "n_copies")


def first_of_class(docs: DataFrame, settings: Near = Near()) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest doc_id.

    Of repeated rows one stays. Where several texts share the smallest doc_id, one text stays; the
    others stay only as the first of another class. A row without id stays if no row of its class has one.
    """
    _, texts = _classified(docs, settings)
    firsts = texts.where("id = label").select("same", "who")
    kept = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(firsts, ["same", "who"], "left_semi")
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("same", "who").orderBy("who"))).where("__n = 1")
    return kept.select("row.*")
