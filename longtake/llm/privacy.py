"""Personal data and the terms that give it away, by corpus co-occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")

SPAN = "array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Disclosure:
    """The whole document of an entity is its context; texts that are the same are one document.

    A term discloses an entity by PMI(entity; term) / IC(entity): 1 where the term occurs only in
    texts of the entity, 0 where they are independent. ``support`` different texts must hold both.
    Terms to count are told to the tasks by a table of at most ``2 ** most_bits`` places.
    """

    support: int = 2
    remove_at: float = 0.95
    generalise_at: float = 0.8
    most_bits: int = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap: per @ the longest local part after the match before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Personal data of one text as (kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the whole words of a text outside of all its entities."""
    edges = np.zeros(len(text) + 1, np.int64)
    for _, a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    taken = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
    for m in _TERM.finditer(text):
        if taken[m.start()] == taken[m.end()]:
            yield m[0].lower(), m.start(), m.end()


def _bit(term: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(term.encode()) & ((1 << bits) - 1)


def _terms(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def _digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def _scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, same, base, entities, terms, text) of every row; terms and text only beside entities."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(t) for t in batch["text"]]
            both = list(zip(batch["text"], base, strict=True))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "same": [_digest(t) for t in batch["text"]],
                    "base": [[dict(zip(("kind", "start", "end"), r, strict=True)) for r in s] for s in base],
                    "entities": [sorted({_entity(k, t[a:b]) for k, a, b in s}) for t, s in both],
                    "terms": [sorted({w for w, _, _ in terms_outside(t, s)}) if s else [] for t, s in both],
                    "text": [t if s else None for t, s in both],
                }
            )

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return stage(
        texts.mapInPandas(scan, f"doc_id string, same binary, base {SPAN}, entities array<string>, terms array<string>, text string")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )


def _with_term(docs: DataFrame, limits: DataFrame, settings: Disclosure) -> DataFrame:
    """(term, with_term): texts that hold a term of ``limits`` (term, most), as far as ``most`` asks.

    The tasks know the terms by a table of places with the highest ``most`` of each place. A task
    sends a term with each of its texts; behind more texts than ``most`` the term cannot disclose
    anything, so no more of them are sent. A term that only shares a place is sent for nothing.
    """
    bits = min(max(16, limits.count().bit_length() + 6), settings.most_bits)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bit": [_bit(t, bits) for t in batch["term"]], "most": batch["most"]})

    asked = limits.mapInPandas(places, "bit int, most long").groupBy("bit").agg(F.max("most").alias("most")).toPandas()
    most = np.zeros(1 << bits, np.uint16)
    most[asked["bit"].to_numpy(np.int64)] = np.minimum(asked["most"].to_numpy(np.int64), 65_535)
    shared = docs.sparkSession.sparkContext.broadcast(most)

    def holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = shared.value
        places: dict[str, int] = {}
        sent: dict[str, set[bytes]] = {}
        for batch in batches:
            terms, texts = [], []
            for text in batch["text"]:
                same = _digest(text)
                for term in _terms(text or ""):
                    limit = places.get(term)
                    if limit is None:
                        if len(places) > 300_000:
                            places.clear()
                        limit = places[term] = int(most[_bit(term, bits)])
                    if limit and (limit == 65_535 or len(sent.setdefault(term, set())) <= limit) and same not in sent.get(term, ()):
                        if limit < 65_535:
                            sent[term].add(same)
                        terms.append(term)
                        texts.append(same)
            yield pd.DataFrame({"term": terms, "same": texts}, dtype=object)

    told = docs.select("text").mapInPandas(holders, "term string, same binary")
    return told.join(limits.select("term"), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("with_term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, settings: Disclosure = Disclosure()) -> DataFrame:
    """(entity, term, kind): what gives an entity away, over all texts; ``found`` is a scan of ``docs``."""
    texts = found.select("same").distinct().count()
    witnesses = found.where(F.size("entities") > 0).dropDuplicates(["same"]).select("same", "entities", "terms")
    entities = witnesses.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    entities = stage(entities.where(F.col("with_entity") >= settings.support))  # others cannot share so many texts with a term
    held = witnesses.select("terms", F.explode("entities").alias("entity")).join(entities, "entity")
    pairs = held.select("entity", "with_entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.first("with_entity").alias("with_entity"), F.count("*").alias("both"))
    # PMI / IC reaches the threshold only up to this many texts with the term; those with entities are a part of them.
    most = F.floor(F.col("both") * F.pow(F.lit(float(texts)) / F.col("with_entity"), F.lit(1 - settings.generalise_at)) * (1 + 1e-9))
    known = witnesses.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("known"))
    pairs = pairs.where(F.col("both") >= settings.support).withColumn("most", most)
    pairs = stage(pairs.join(known, "term").where(F.col("known") <= F.col("most")).drop("known"))
    limits = stage(pairs.groupBy("term").agg(F.max("most").alias("most")))
    content = F.log2(F.lit(float(texts)) / F.col("with_entity"))
    pmi = F.log2(F.col("both") * F.lit(float(texts)) / (F.col("with_entity") * F.col("with_term")))
    told = F.when(content > 0, pmi / content).otherwise(0.0)
    kind = F.when(told >= settings.remove_at, "removed").when(told >= settings.generalise_at, "generalised")
    disclosing = pairs.join(_with_term(docs, limits, settings), "term").select("entity", "term", kind.alias("kind"))
    return stage(disclosing.where("kind is not null"))


def personal_data(docs: DataFrame, settings: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, base, spans) for every row: base spans, and those of disclosing terms added.

    Null text is empty and has no spans; null ids stay null; repeated rows are reported each, but
    equal texts are one witness; other columns are ignored; an empty table gives no rows. Counts
    cover all rows: texts with an entity, with a term, and with both, anywhere in the text. Every
    occurrence of a disclosing term in a row with its entity is a span.
    """
    found = _scanned(docs)
    disclosing = disclosing_terms(docs, found, settings)
    named = found.select("row", "terms", F.explode("entities").alias("entity"))
    named = named.join(disclosing.select("entity").distinct(), "entity", "left_semi").select("row", "entity", F.explode("terms").alias("term"))
    told = named.join(disclosing, ["entity", "term"]).groupBy("row", "term").agg(F.max("kind").alias("kind"))  # removed outranks generalised
    told = told.groupBy("row").agg(F.collect_list(F.struct("term", "kind")).alias("told"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            extra = []
            for text, base, kinds in zip(batch["text"], batch["base"], batch["told"], strict=True):
                kind = {t["term"]: t["kind"] for t in kinds}
                found = terms_outside(text, [(s["kind"], s["start"], s["end"]) for s in base])
                extra.append([{"kind": kind[w], "start": a, "end": b} for w, a, b in found if w in kind])
            yield pd.DataFrame({"row": batch["row"], "extra": extra})

    hits = found.select("row", "text", "base").join(told, "row").mapInPandas(mark, f"row long, extra {SPAN}")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))
    keyed = F.array_sort(
        F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(hits, "row", "left").select("doc_id", "base", spans.alias("spans"))


def cut_spans(text: str | None, spans: list) -> str | None:
    """One text without its spans: entities as their kind, general terms as a mark, others gone."""
    if text is None:
        return None
    at, parts = 0, []
    for s in spans:
        if s["start"] >= at:
            mark = {"removed": "", "generalised": "[TERM]"}.get(s["kind"], f"[{s['kind'].upper()}]")
            parts += [text[at : s["start"]], mark]
            at = s["end"]
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, settings: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with the found spans taken out of ``text``; every row and column stays.

    Rows are written with a number of their own, so null and repeated ids do no harm.
    """
    row = next(n for n in ("row", *(f"row_{i}" for i in range(len(docs.columns) + 1))) if n.lower() not in {c.lower() for c in docs.columns})
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    found = personal_data(numbered.select(F.col(row).alias("doc_id"), "text"), settings).select(F.col("doc_id").alias(row), F.col("spans"))
    cut = F.pandas_udf(lambda t, s: pd.Series([cut_spans(a, b) for a, b in zip(t, s, strict=True)]), "string")
    spans = found.select(row, F.col("spans").alias(f"{row}_spans"))
    joined = numbered.join(spans, row).withColumn("text", cut("text", f"{row}_spans"))
    return joined.select(*docs.columns)
