"""Edge cases: limits, bad dates, wildcards, key 0, empty inputs, NULL FKs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from routeledger.functions import predicates as P
from routeledger.operators import activity as U
from routeledger.operators import checks as C
from routeledger.operators import ledger as G
from routeledger.operators import listings as L
from routeledger.operators import reports as R


@pytest.mark.parametrize("limit,expect", [(0, 1000), (-1, 1), (5000, 1000), ("abc", 1000), (7, 7), (None, 1000)])
def test_limit_clamp(limit, expect):
    assert L.clamp_limit(limit) == expect


def test_listing_validation(seed):
    with pytest.raises(ValueError):
        L.list_records(seed, "company_settings")
    with pytest.raises(ValueError):
        L.list_records(seed, "products", order_by="secret DESC")
    with pytest.raises(ValueError):
        L.list_records(seed, "products", order_by="name SIDEWAYS")
    with pytest.raises(ValueError):
        P.filter_equals(seed.products, {"nope": 1})
    assert L.list_records(seed, "products", order_by="name", limit=0).count() == 15
    assert L.list_records(seed, "products", offset=10).count() == 5


def test_bad_date_selects_nothing(seed):
    assert R.sales_by_product(seed, "not-a-date", "2024-12-31").count() == 0
    assert L.sales_enriched(seed, from_="2024-13-45").count() == 0


def test_wildcards_and_backslash(seed):
    assert P.search_products(seed, "%").count() == 15
    assert P.search_products(seed, "R_ce").count() == 1      # '_' is a wildcard, as in SQL LIKE
    assert P.search_products(seed, "\\").count() == 0       # a stray backslash must not fail
    assert P.search_products(seed, "rice").count() == 1     # case-insensitive


def test_key_zero_is_a_real_filter(star):
    zero = L.sales_enriched(star, salesperson_id=0, ordered=False)
    assert zero.count() > 0
    assert zero.filter(F.col("salesperson_id") != 0).count() == 0


def test_empty_inputs(spark, seed):
    empty = seed.with_tables(sales=seed.sales.limit(0), sale_items=seed.sale_items.limit(0),
                             collections=seed.collections.limit(0))
    perf = R.salesperson_performance(empty, "2024-01-01", "2024-12-31").collect()
    assert len(perf) == 8 and all(r.total_sales == 0 and r.total_amount is None for r in perf)
    assert R.kpi_cards(empty, "2024-01-01", "2024-12-31").first().avg_order_value is None
    assert R.dashboard_stats(empty, "2024-01-01").first().today_sales == 0


def test_orphans_and_null_fks(spark, seed):
    bad_sale = spark.createDataFrame([(999, 77, None)], "id bigint, shop_id bigint, salesperson_id bigint")
    t = seed.with_tables(sales=seed.sales.unionByName(bad_sale, allowMissingColumns=True))
    orphans = {(r.table, r.column, r.value) for r in C.orphan_keys(t).collect()}
    assert ("sales", "shop_id", 77) in orphans
    assert any(r.rule == "salesperson_id missing" for r in C.invalid_facts(t).collect())
    names = L.sales_enriched(t, ordered=False).filter(F.col("id") == 999).first()
    assert names.shop_name is None and names.salesperson_name is None


def test_zero_credit_and_minimum(spark, seed):
    shops = seed.shops.withColumn("credit_limit", F.when(F.col("id") == 1, F.lit(0)).otherwise(F.col("credit_limit"))
                                  .cast("decimal(18,2)"))
    risk = {r.shop_id: r.risk_level for r in R.shop_outstanding(seed.with_tables(shops=shops)).collect()}
    assert risk[1] == "No Credit"
    prods = seed.products.withColumn("min_stock_level", F.lit(0).cast("bigint")).withColumn(
        "stock_quantity", F.when(F.col("id") == 2, 0).otherwise(F.col("stock_quantity")).cast("bigint"))
    alerts = R.low_stock_alerts(seed.with_tables(products=prods)).collect()
    assert [(a.id, a.urgency) for a in alerts] == [(2, "critical")]


def test_statement_running_balance(seed):
    st = G.shop_statement(seed, [7]).collect()
    assert [r.source for r in st] == ["collection", "sale"]
    assert st[-1].running_debt == pytest.approx(-1250 + 5000)


def test_recent_activity_union(seed):
    acts = U.recent_activity(seed, "2024-06-28").collect()
    assert {(a.type, a.reason) for a in acts} == {("return", None)}


def test_dense_ids_are_consecutive(spark):
    from routeledger.functions.windows import dense_ids
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    out = dense_ids(df, ["k"], 100).orderBy("k").collect()
    assert [r.id for r in out] == list(range(101, 1101))
