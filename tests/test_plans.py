"""Physical-plan properties: no Python on the core path, pushed filters,
pruned scans, no cartesian products over facts."""

from __future__ import annotations

import pytest

from routeledger.operators import listings as L
from routeledger.operators import reports as R

FROM, TO = "1998-01-01", "1998-12-31"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CORE = {
    "sales_by_product": lambda t: R.sales_by_product(t, FROM, TO),
    "salesperson_performance": lambda t: R.salesperson_performance(t, FROM, TO),
    "stock_level_report": lambda t: R.stock_level_report(t, "1998-06-30"),
    "sales_enriched": lambda t: L.sales_enriched(t, FROM, TO),
    "shop_outstanding": lambda t: R.shop_outstanding(t),
}


@pytest.mark.parametrize("name", sorted(CORE))
def test_no_python_and_no_cartesian(star, name):
    p = plan(CORE[name](star))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct"):
        assert bad not in p, (name, bad)


def test_date_filter_reaches_the_scan(star):
    df = R.sales_by_product(star, FROM, TO)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text or "o_orderdate" in text
    formatted = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    explained = df._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(o_orderdate" in explained


def test_scan_reads_only_needed_columns(star):
    df = R.sales_by_product(star, FROM, TO)
    formatted = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    explained = df._jdf.queryExecution().explainString(formatted)
    lineitem_schema = [ln for ln in explained.splitlines() if "ReadSchema" in ln and "l_orderkey" in ln]
    assert lineitem_schema, explained
    assert all("l_comment" not in ln and "l_shipdate" not in ln for ln in lineitem_schema)


def test_top_k_is_take_ordered(star):
    p = plan(L.recent_sales(star, 10))
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("report,joins", [(R.sales_report, 3), (R.collections_report, 2), (R.issues_report, 0)])
def test_reports_join_names_once(seed, report, joins):
    """Detail and total from one evaluation: each name is joined once (those of the issues in the staged detail)."""
    optimised = report(seed)._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("Join LeftOuter") == joins
