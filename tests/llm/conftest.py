from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang, source]) with any rows missing filled."""

    def make(rows, extra: bool = False):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use for columns of their own
            docs = docs.selectExpr("*", "'x' AS size", "'y' AS copies", "'z' AS shard", "1 AS n_words", "'k' AS chunk", "'l' AS label")
        return docs

    return make


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables as a folder that a query can read."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
