"""The driver contract in __spark_entry__.py."""

from __future__ import annotations

import __spark_entry__ as entry_module


def test_entry_runs_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["salesperson_id", "salesperson_name"]
    assert df.count() > 0


def test_oracle_keys_are_queries_and_parse(duck):
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    for name, text in o.items():
        duck.sql(f"select * from ({text}) x limit 0")  # binds every view and column
