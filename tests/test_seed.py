"""Golden values on the reference's seed data (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from routeledger.operators import checks as C
from routeledger.operators import ledger as G
from routeledger.operators import reports as R

FROM, TO = dt.date(2024, 1, 1), dt.date(2024, 12, 31)

# Expected per-salesperson figures on the seed.
PERF = {  # sales n, total, paid, balance, collections n, coll total, compat total, compat coll
    1: (3, 1900, 1380, 520, 1, 4300, 1900, 12900),
    2: (3, 1310, 1060, 250, 1, 1500, 1310, 4500),
    3: (3, 1900, 1600, 300, 1, 500, 1900, 1500),
    4: (3, 1350, 800, 550, 1, 200, 1350, 600),
    5: (3, 1850, 1600, 250, 1, 4000, 1850, 12000),
    6: (3, 1600, 1400, 200, 1, 620, 1600, 1860),
    7: (3, 24500, 16500, 8000, 2, 3850, 49000, 11550),
    8: (1, 600, 600, 0, 1, 800, 600, 800),
}
STOCK = {1: (5, 300, 176050), 2: (4, 230, 23700), 3: (4, 215, 60900), 4: (4, 260, 19600),
         5: (4, 130, 22150), 6: (3, 225, 20675), 7: (3, 75, 153300), 8: (3, 130, 11400)}


def test_salesperson_performance(seed):
    rows = {r.salesperson_id: r for r in R.salesperson_performance(seed, FROM, TO).collect()}
    compat = {r.salesperson_id: r for r in R.salesperson_performance(seed, FROM, TO, compat=True).collect()}
    assert set(rows) == set(PERF)
    for sp, (n, tot, paid, bal, nc, ct, ctot, cct) in PERF.items():
        r, c = rows[sp], compat[sp]
        assert (r.total_sales, r.total_amount, r.total_paid, r.total_balance) == (n, tot, paid, bal)
        assert (r.total_collections, r.collection_amount) == (nc, ct)
        assert (c.total_amount, c.collection_amount) == (ctot, cct)


def test_stock_summaries(seed):
    a1 = {r.id: (r.product_count, r.total_stock_quantity, r.stock_value)
          for r in R.salesperson_stock_summary(seed).collect()}
    a10 = {r.salesperson_id: (r.product_count, r.total_quantity, r.total_value)
           for r in R.field_stock_distribution(seed).collect()}
    assert a1 == STOCK
    assert a10 == STOCK


def test_headline_values(seed):
    assert R.dashboard_stats(seed, "2024-06-28").first().total_outstanding == -76500
    inv = R.inventory_value(seed).filter(F.col("level") == 3).first()
    assert inv.value == 1344000
    assert R.field_stock_value(seed).first().total == 487775
    field_units = seed.salesperson_stock.agg(F.sum("quantity")).first()[0]
    assert field_units == 1565
    sales = seed.sales.agg(F.count("*"), F.sum("total_amount"), F.sum("balance_amount")).first()
    assert (sales[0], float(sales[1]), float(sales[2])) == (22, 35010, 10070)
    colls = seed.collections.agg(F.count("*"), F.sum("amount")).first()
    assert (colls[0], float(colls[1])) == (9, 15770)
    items = seed.sale_items.agg(F.sum("quantity"), F.sum("total_price")).first()
    assert (items[0], float(items[1])) == (180, 28020)


def test_stock_reports(seed):
    assert R.low_stock_alerts(seed).count() == 0
    statuses = {r.stock_status for r in R.stock_level_report(seed, "2024-06-30").collect()}
    assert statuses == {"Good Stock"}
    p5 = R.sales_by_product(seed, FROM, TO).filter(F.col("product_id") == 5).first()
    assert (p5.total_quantity, p5.total_amount) == (20, 3600)


def test_shop_outstanding(seed):
    rows = {r.shop_name: r.risk_level for r in R.shop_outstanding(seed).collect()}
    assert len(rows) == 10
    assert rows["Prime Store"] == "Medium Risk"
    assert rows["Mini Mart"] == "Low Risk"  # exactly 50 %
    assert sum(v == "Low Risk" for v in rows.values()) == 9


def test_positions_and_reconcile(seed):
    pos = {(r.resource, r.k1, r.k2): r.level for r in G.positions(seed).collect()}
    # issue 100 of product 1 to SP1, return 10: warehouse -90, field +90
    assert pos[("warehouse", 1, -1)] == -90
    assert pos[("field", 1, 1)] == 90  # SP1 sold no product 1 (its lines are in sales 10 and 15)
    # stored state is not history-consistent on the seed (FIXTURES §2 note)
    assert C.reconcile(seed).count() > 0


@pytest.mark.parametrize("days", [30, 1])
def test_stock_level_window(seed, days):
    out = R.stock_level_report(seed, "2024-06-30", days=days)
    assert out.count() == 15
