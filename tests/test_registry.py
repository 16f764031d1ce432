from __future__ import annotations

import __spark_entry__ as entry
from longtake.queries import registry

WITHOUT_TWIN = {"col_4_repetition_gate"}


def test_every_query_has_a_twin_or_is_known_to_have_none():
    queries, twins = registry.all_queries(), registry.all_oracles()
    assert set(queries) - set(twins) == WITHOUT_TWIN
    assert set(twins) <= set(queries)
    assert set(queries) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_of_the_inventory_has_a_query():
    names = list(entry.queries())
    wanted = {"src": 4, "snk": 4, "flt": 10, "join": 11, "agg": 16, "win": 17, "top": 4, "set": 3, "col": 12, "str": 8}
    for group, count in wanted.items():
        for n in range(1, count + 1):
            assert any(q.startswith(f"{group}_{n}_") for q in names), f"{group}-{n}"


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.speech_percent <= 100.0 for r in rows)
