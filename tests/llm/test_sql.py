"""The registered SQL of the corpus queries gives the queries' rows."""

from __future__ import annotations

import pytest

from routeledger.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


def _rows(table):
    cols = sorted(table.column_names)
    key = lambda r: tuple((x is not None, round(x, 9) if isinstance(x, float) else x) for x in r)
    return cols, sorted(map(key, zip(*[table.column(c).to_pylist() for c in cols], strict=True)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(corpus_spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.register(t, corpus_spark.read.parquet(f"{D}/{t}.parquet").toArrow())
    want = con.sql(SQL[name])
    want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow()
    assert _rows(QUERIES[name](corpus_spark, D).toArrow()) == _rows(want)


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
