"""A1..A31: aggregate reports and dashboards.

Shape rule used throughout: aggregate each fact on its foreign key first
(partial aggregation on the map side, one shuffle on the key), then join
the small aggregate to the dimension for names.  Catalyst does not push an
aggregate below a join by itself, so the reference's join-then-group is
rewritten by hand; it also removes the sales × collections fan-out (Q7).
Money sums stay DECIMAL and are cast to double only at the output.
Counting rows of a fact by its primary key uses ``count(id)``: with the
key unique (a table constraint) it equals the reference's
``COUNT(DISTINCT id)`` without the extra shuffle a distinct count needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import category_key, date_range, filter_sales, id_frame, where
from ..functions.scalars import (as_date, day_of, risk_level, stock_status, to_double,
                                 urgency, urgency_rank)
from ..session import materialize
from ..tables import Tables


def _names(df: DataFrame, dim: DataFrame, fk: str, **cols: str) -> DataFrame:
    """Left join selected dimension columns (``out=dim_col``) on ``fk``."""
    sel = [F.col("id").alias(fk)] + [F.col(src).alias(out) for out, src in cols.items()]
    return df.join(dim.select(*sel), fk, "left")


def _dbl(name: str, col: Column | None = None) -> Column:
    return to_double(col if col is not None else F.col(name)).alias(name)


def _stock_with_price(t: Tables) -> DataFrame:
    """salesperson_stock LEFT JOIN products, only the columns the stock reports read."""
    prices = t.products.select(F.col("id").alias("product_id"), "unit_price",
                               F.col("is_active").alias("product_active"))
    return t.salesperson_stock.select("salesperson_id", "product_id", "quantity").join(prices, "product_id", "left")


# ---------------------------------------------------------------- A1
def salesperson_stock_summary(t: Tables, active_only: bool = True) -> DataFrame:
    """A1: per salesperson, distinct products held, units and value (0 when none)."""
    agg = (_stock_with_price(t).groupBy("salesperson_id")
           .agg(F.count_distinct("product_id").alias("product_count"),
                F.sum("quantity").alias("total_stock_quantity"),
                F.sum(F.col("quantity") * F.col("unit_price")).alias("stock_value")))
    sp = t.salespersons
    if active_only:
        sp = sp.filter(F.col("is_active") == 1)
    out = sp.select("id", "code", "name", "vehicle_number", "is_active").join(
        agg.withColumnRenamed("salesperson_id", "id"), "id", "left")
    return out.select("id", "code", "name", "vehicle_number", "is_active",
                      F.coalesce("product_count", F.lit(0)).alias("product_count"),
                      F.coalesce("total_stock_quantity", F.lit(0)).cast("bigint").alias("total_stock_quantity"),
                      _dbl("stock_value", F.coalesce("stock_value", F.lit(0)))).orderBy("name", "id")


# ---------------------------------------------------------------- A2
def daily_sales_by_salesperson(t: Tables, date) -> DataFrame:
    """A2: the day's sales per salesperson FK (a missing salesperson gives a NULL name)."""
    day = as_date(date)
    agg = (t.sales.filter(day_of("date") == day).groupBy("salesperson_id")
           .agg(F.count("id").alias("total_sales"), F.sum("total_amount").alias("total_amount"),
                F.sum("paid_amount").alias("total_paid"), F.sum("balance_amount").alias("total_balance")))
    out = _names(agg, t.salespersons, "salesperson_id", salesperson_name="name")
    return out.select("salesperson_id", day.alias("sale_date"), "salesperson_name", "total_sales",
                      _dbl("total_amount"), _dbl("total_paid"), _dbl("total_balance")
                      ).orderBy(F.desc("total_amount"), "salesperson_id")


# ---------------------------------------------------------------- A3
def _product_sales(t: Tables, from_, to_) -> DataFrame:
    sales = where(t.sales.select("id", "date"), date_range("date", from_, to_)).select(F.col("id").alias("sale_id"))
    items = t.sale_items.select("sale_id", "product_id", "quantity", "total_price")
    return (items.join(sales, "sale_id").groupBy("product_id")
            .agg(F.sum("quantity").alias("total_quantity"), F.sum("total_price").alias("total_amount"),
                 F.count_distinct("sale_id").alias("sale_count")))


def sales_by_product(t: Tables, from_=None, to_=None) -> DataFrame:
    """A3: units, revenue and distinct sales per product in a date range."""
    out = _names(_product_sales(t, from_, to_), t.products, "product_id", code="code", name="name")
    return out.select("product_id", "code", "name", "total_quantity", _dbl("total_amount"), "sale_count"
                      ).orderBy(F.desc("total_quantity"), "product_id")


# ---------------------------------------------------------------- A4
def daily_collections_by_salesperson(t: Tables, date) -> DataFrame:
    """A4: the day's collections per salesperson."""
    day = as_date(date)
    agg = (t.collections.filter(day_of("date") == day).groupBy("salesperson_id")
           .agg(F.count("id").alias("total_collections"), F.sum("amount").alias("total_amount")))
    out = _names(agg, t.salespersons, "salesperson_id", salesperson_name="name")
    return out.select("salesperson_id", day.alias("collection_date"), "salesperson_name", "total_collections",
                      _dbl("total_amount")).orderBy(F.desc("total_amount"), "salesperson_id")


# ---------------------------------------------------------------- A5
def daily_sales_summary(t: Tables, from_, to_=None) -> DataFrame:
    """A5: per day count and sums; one day when ``to_`` is omitted."""
    to_ = from_ if to_ is None else to_
    s = where(t.sales, date_range("date", from_, to_))
    return (s.groupBy(day_of("date").alias("sale_date"))
            .agg(F.count(F.lit(1)).alias("total_sales"), F.sum("total_amount").alias("total_amount"),
                 F.sum("paid_amount").alias("total_paid"), F.sum("balance_amount").alias("total_balance"))
            .select("sale_date", "total_sales", _dbl("total_amount"), _dbl("total_paid"), _dbl("total_balance"))
            .orderBy("sale_date"))


# ---------------------------------------------------------------- A6
def salesperson_performance(t: Tables, from_=None, to_=None, coll_from=None, coll_to=None,
                            compat: bool = False) -> DataFrame:
    """Active salespersons with sales and collection totals in a range.

    Each fact is aggregated per salesperson before the join, so the result
    is exact and there is no sales × collections fan-out.  ``compat=True``
    reproduces the reference's multiplied sums arithmetically (Q7).
    Collections may use their own range (``coll_from/coll_to``)."""
    coll_from = from_ if coll_from is None else coll_from
    coll_to = to_ if coll_to is None else coll_to
    s = (filter_sales(t.sales, from_=from_, to_=to_).groupBy("salesperson_id")
         .agg(F.count("id").alias("total_sales"), F.sum("total_amount").alias("total_amount"),
              F.sum("paid_amount").alias("total_paid"), F.sum("balance_amount").alias("total_balance")))
    c = (filter_sales(t.collections, from_=coll_from, to_=coll_to).groupBy("salesperson_id")
         .agg(F.count("id").alias("total_collections"), F.sum("amount").alias("collection_amount")))
    sp = t.salespersons.filter(F.col("is_active") == 1).select(
        F.col("id").alias("salesperson_id"), F.col("name").alias("salesperson_name"))
    out = sp.join(s, "salesperson_id", "left").join(c, "salesperson_id", "left")
    n_s = F.coalesce("total_sales", F.lit(0))
    n_c = F.coalesce("total_collections", F.lit(0))
    sale_mult = F.greatest(n_c, F.lit(1)) if compat else F.lit(1)
    coll_mult = F.greatest(n_s, F.lit(1)) if compat else F.lit(1)
    return out.select(
        "salesperson_id", "salesperson_name", n_s.alias("total_sales"),
        _dbl("total_amount", F.col("total_amount") * sale_mult),
        _dbl("total_paid", F.col("total_paid") * sale_mult),
        _dbl("total_balance", F.col("total_balance") * sale_mult),
        n_c.alias("total_collections"),
        _dbl("collection_amount", F.col("collection_amount") * coll_mult),
    ).orderBy(F.desc("total_amount"), "salesperson_id")


# ---------------------------------------------------------------- A7
def shops_located(shops: DataFrame, t: Tables) -> DataFrame:
    """shops + district, town and route names (the J1 join, shared)."""
    out = _names(shops, t.districts, "district_id", district_name="name")
    out = _names(out, t.towns, "town_id", town_name="name")
    return _names(out, t.routes, "route_id", route_name="name")


def shop_outstanding(t: Tables) -> DataFrame:
    """Debtors (balance < 0) with location names and risk level."""
    debtors = t.shops.filter(F.col("current_balance") < 0).select(
        "id", "name", "owner_name", "contact_number", "current_balance", "credit_limit",
        "district_id", "town_id", "route_id")
    out = shops_located(debtors, t)
    return out.select(F.col("id").alias("shop_id"), F.col("name").alias("shop_name"), "owner_name", "contact_number",
                      _dbl("current_balance"), _dbl("credit_limit"), "route_name", "town_name", "district_name",
                      risk_level().alias("risk_level")).orderBy("current_balance", "shop_name", "shop_id")


# ---------------------------------------------------------------- A8
def stock_level_report(t: Tables, as_of=None, compat: bool = False, days: int = 30) -> DataFrame:
    """Stock status of active products and units sold in the last ``days``.

    Default counts sales dated in ``[as_of - days, as_of]``; ``compat=True``
    counts all time, as the reference's misplaced date test does (Q8)."""
    items = t.sale_items.select("sale_id", "product_id", "quantity")
    if not compat:
        day = as_date(as_of)
        recent = t.sales.filter(day_of("date").between(F.date_sub(day, days), day)).select(F.col("id").alias("sale_id"))
        items = items.join(recent, "sale_id")
    sold = items.groupBy("product_id").agg(F.sum("quantity").alias("total_sold_last_month"))
    p = t.products.filter(F.col("is_active") == 1).select(
        "id", "code", "name", "stock_quantity", "min_stock_level", "unit", "unit_price")
    out = p.join(sold.withColumnRenamed("product_id", "id"), "id", "left")
    return out.select("id", "code", "name", "stock_quantity", "min_stock_level", "unit", _dbl("unit_price"),
                      stock_status().alias("stock_status"),
                      F.coalesce("total_sold_last_month", F.lit(0)).cast("bigint").alias("total_sold_last_month")
                      ).orderBy("stock_status", "name", "id")


# ---------------------------------------------------------------- A9
def low_stock_alerts(t: Tables) -> DataFrame:
    """Active products at or below minimum, with deficit, values and urgency."""
    p = t.products.filter((F.col("stock_quantity") <= F.col("min_stock_level")) & (F.col("is_active") == 1))
    return p.select(
        "id", "code", "name", "category", "stock_quantity", "min_stock_level", _dbl("unit_price"),
        (F.col("min_stock_level") - F.col("stock_quantity")).alias("deficit"),
        _dbl("current_value", F.col("stock_quantity") * F.col("unit_price")),
        _dbl("target_value", F.col("min_stock_level") * F.col("unit_price")),
        urgency().alias("urgency"), urgency_rank().alias("urgency_rank"),
    ).orderBy("urgency_rank", "name", "id")


# ---------------------------------------------------------------- A10
def field_stock_distribution(t: Tables) -> DataFrame:
    """A10: field stock per active salesperson; only those holding units."""
    agg = (_stock_with_price(t).groupBy("salesperson_id")
           .agg(F.count_distinct("product_id").alias("product_count"),
                F.sum("quantity").alias("total_quantity"),
                F.sum(F.col("quantity") * F.col("unit_price")).alias("total_value"),
                F.sum("unit_price").alias("price_sum"), F.count("unit_price").alias("price_n"))
           .filter(F.col("total_quantity") > 0))
    sp = t.salespersons.filter(F.col("is_active") == 1).select(
        F.col("id").alias("salesperson_id"), F.col("name").alias("salesperson_name"),
        F.col("code").alias("salesperson_code"), "vehicle_number")
    out = sp.join(agg, "salesperson_id")
    mean = F.try_divide(F.col("price_sum").cast("double"), F.col("price_n").cast("double"))
    return out.select("salesperson_id", "salesperson_name", "salesperson_code", "vehicle_number", "product_count",
                      "total_quantity", _dbl("total_value", F.coalesce("total_value", F.lit(0))),
                      F.coalesce(mean, F.lit(0.0)).alias("avg_product_price")
                      ).orderBy(F.desc("total_value"), "salesperson_id")


# ---------------------------------------------------------------- A11
def field_stock_value(t: Tables) -> DataFrame:
    """Value of positive field stock of active products, one row (0 when empty)."""
    s = _stock_with_price(t).filter((F.col("quantity") > 0) & (F.col("product_active") == 1))
    return s.agg(_dbl("total", F.coalesce(F.sum(F.col("quantity") * F.col("unit_price")), F.lit(0))))


# ---------------------------------------------------------------- A12 / A13
def _value_by_product(df: DataFrame, t: Tables, qty: str, counts: dict[str, Column]) -> DataFrame:
    """Pre-aggregate a movement table per product (counts + units), then value it."""
    per = df.groupBy("product_id").agg(F.sum(qty).alias("_units"), *[c.alias(n) for n, c in counts.items()])
    priced = _names(per, t.products, "product_id", _price="unit_price")
    return priced


def return_statistics(t: Tables, date) -> DataFrame:
    """One row of return counters and total value."""
    day = as_date(date)
    r = t.stock_returns
    per = _value_by_product(r, t, "quantity_returned", {
        "n": F.count(F.lit(1)),
        "n_today": F.count(F.when(day_of("date") == day, 1)),
        "n_damaged": F.count(F.when(F.col("reason").isin("damaged", "defective"), 1)),
        "n_pending": F.count(F.when(F.col("inspection_required") == 1, 1)),
    })
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_returned"),
                   F.coalesce(F.sum("n_today"), F.lit(0)).alias("today_returned"),
                   F.coalesce(F.sum("n_damaged"), F.lit(0)).alias("damaged_returns"),
                   F.coalesce(F.sum("n_pending"), F.lit(0)).alias("pending_inspection"),
                   _dbl("total_value", F.coalesce(F.sum(F.col("_units") * F.col("_price")), F.lit(0))))


def issue_statistics(t: Tables, date) -> DataFrame:
    """One row of issue counters, distinct products/salespersons and value."""
    day = as_date(date)
    i = t.stock_issues
    per = _value_by_product(i, t, "quantity_issued", {
        "n": F.count(F.lit(1)),
        "n_today": F.count(F.when(day_of("date") == day, 1)),
    })
    totals = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_issued"),
                     F.coalesce(F.sum("n_today"), F.lit(0)).alias("today_issued"),
                     F.count("product_id").alias("unique_products"),
                     _dbl("total_value", F.coalesce(F.sum(F.col("_units") * F.col("_price")), F.lit(0))))
    sps = i.agg(F.count_distinct("salesperson_id").alias("unique_salespersons"))
    # Both sides are single-row global aggregates.
    return totals.crossJoin(sps).select("total_issued", "today_issued", "unique_products",
                                        "unique_salespersons", "total_value")


# ---------------------------------------------------------------- A14 / A15
def count_issues(t: Tables, **filters) -> DataFrame:
    """Filtered count of issues, same predicate builder as the listing."""
    from .listings import issues_filtered
    return issues_filtered(t, **filters).agg(F.count(F.lit(1)).alias("count"))


def count_returns(t: Tables, **filters) -> DataFrame:
    """Filtered count of returns (J10's predicates)."""
    from .listings import returns_filtered
    return returns_filtered(t, **filters).agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- A16
def dashboard_stats(t: Tables, as_of) -> DataFrame:
    """Seven headline numbers in one row (shops counted regardless of flag)."""
    day = as_date(as_of)
    products = t.products.agg(F.count(F.when(F.col("is_active") == 1, 1)).alias("total_products"))
    sps = t.salespersons.agg(F.count(F.when(F.col("is_active") == 1, 1)).alias("total_salespersons"))
    shops = t.shops.agg(F.count(F.lit(1)).alias("total_shops"),
                        F.coalesce(F.sum(F.when(F.col("current_balance") < 0, F.col("current_balance"))),
                                   F.lit(0)).alias("total_outstanding"))
    sales = t.sales.filter(day_of("date") == day).agg(
        F.count(F.lit(1)).alias("today_sales"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("today_sales_amount"))
    colls = t.collections.filter(day_of("date") == day).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("today_collections"))
    # Each side is a one-row global aggregate, so the cross joins stay one row.
    one = products.crossJoin(sps).crossJoin(shops).crossJoin(sales).crossJoin(colls)
    return one.select("total_products", "total_salespersons", "total_shops", "today_sales",
                      _dbl("today_sales_amount"), _dbl("today_collections"), _dbl("total_outstanding"))


# ---------------------------------------------------------------- A17
def category_product_counts(t: Tables) -> DataFrame:
    """Categories with their product count (case-insensitive, missing = general)."""
    counts = t.products.groupBy(category_key().alias("_k")).agg(F.count(F.lit(1)).alias("product_count"))
    c = t.product_categories.select("id", "code", "value", "name")
    out = c.join(counts, F.lower(c["value"]) == counts["_k"], "left")
    return out.select("id", "code", "value", "name", F.coalesce("product_count", F.lit(0)).alias("product_count")
                      ).orderBy("name", "id")


# ---------------------------------------------------------------- A18
_USAGE = {
    "product": [("sale_items", "product_id", "sale_item_count", None),
                ("stock_issues", "product_id", "issue_count", None),
                ("stock_returns", "product_id", "return_count", None)],
    "shop": [("sales", "shop_id", "sale_count", None), ("collections", "shop_id", "collection_count", None)],
    "salesperson": [("salesperson_stock", "salesperson_id", "stock_count", "quantity > 0"),
                    ("sales", "salesperson_id", "sale_count", None),
                    ("collections", "salesperson_id", "collection_count", None)],
    "district": [("towns", "district_id", "town_count", None)],
    "town": [("routes", "town_id", "route_count", None), ("shops", "town_id", "shop_count", None)],
    "route": [("shops", "route_id", "shop_count", None), ("sales", "route_id", "sale_count", None)],
}
_ENTITY_TABLE = {"product": "products", "shop": "shops", "salesperson": "salespersons",
                 "district": "districts", "town": "towns", "route": "routes"}


def entity_usage(t: Tables, entity: str, ids=None) -> DataFrame:
    """Reference counts per entity id (decides soft vs hard delete)."""
    if entity not in _USAGE:
        raise ValueError(f"unknown entity {entity!r}")
    base = t.get(_ENTITY_TABLE[entity]).select("id")
    if ids is not None:
        base = base.join(id_frame(base.sparkSession, ids), "id", "left_semi")
    out = base
    names = []
    for table, fk, name, pred in _USAGE[entity]:
        child = t.get(table)
        if pred is not None:
            child = child.filter(F.expr(pred))
        cnt = child.groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(cnt, "id", "left")
        names.append(name)
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in names]
    in_use = F.greatest(*[F.coalesce(n, F.lit(0)) for n in names]) > 0 if len(names) > 1 \
        else F.coalesce(names[0], F.lit(0)) > 0
    return out.select("id", *counts, in_use.alias("in_use"))


# ---------------------------------------------------------------- A19
def kpi_cards(t: Tables, from_=None, to_=None, coll_from=None, coll_to=None) -> DataFrame:
    """Eight KPIs in one row (each side a one-row aggregate)."""
    coll_from = from_ if coll_from is None else coll_from
    coll_to = to_ if coll_to is None else coll_to
    s = where(t.sales, date_range("date", from_, to_)).agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"), F.count(F.lit(1)).alias("transactions"))
    c = where(t.collections, date_range("date", coll_from, coll_to)).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("collections"))
    sh = t.shops.agg(F.coalesce(F.sum(F.when(F.col("current_balance") < 0, F.col("current_balance"))), F.lit(0))
                     .alias("outstanding"),
                     F.count(F.when(F.col("is_active") == 1, 1)).alias("active_shops"))
    p = t.products.filter(F.col("is_active") == 1).agg(
        F.count(F.lit(1)).alias("active_products"),
        F.count(F.when(F.col("stock_quantity") > F.col("min_stock_level"), 1)).alias("_healthy"))
    one = s.crossJoin(c).crossJoin(sh).crossJoin(p)
    revenue = F.col("revenue").cast("double")
    return one.select(
        revenue.alias("revenue"), _dbl("collections"), _dbl("outstanding"),
        F.try_divide(F.lit(100.0) * F.col("_healthy").cast("double"), F.col("active_products").cast("double"))
         .alias("inventory_health"),
        "transactions",
        F.try_divide(revenue, F.col("transactions").cast("double")).alias("avg_order_value"),
        "active_shops", "active_products")


# ---------------------------------------------------------------- A20
_GRAINS = {"day": "day", "week": "week", "month": "month"}


def sales_trend(t: Tables, from_, to_, grain: str = "day") -> DataFrame:
    """Revenue and count per day/week/month bucket; empty buckets are 0.

    The calendar is generated on the executors (``sequence`` + ``explode``)
    and is as long as the range, never a driver-side list."""
    unit = _GRAINS[grain]
    start, end = as_date(from_), as_date(to_)
    spark = t.sales.sparkSession
    cal = (spark.range(1).select(F.explode(F.sequence(start, end)).alias("d"))
           .select(F.to_date(F.date_trunc(unit, F.col("d"))).alias("bucket")).distinct())
    s = where(t.sales.select("date", "total_amount"), date_range("date", from_, to_))
    agg = (s.groupBy(F.to_date(F.date_trunc(unit, F.col("date"))).alias("bucket"))
           .agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("sale_count")))
    out = cal.join(agg, "bucket", "left")
    return out.select("bucket", _dbl("revenue", F.coalesce("revenue", F.lit(0))),
                      F.coalesce("sale_count", F.lit(0)).alias("sale_count")).orderBy("bucket")


# ---------------------------------------------------------------- A21
def payment_distribution(t: Tables, from_=None, to_=None) -> DataFrame:
    """Count, amount and share of amount by payment method and type."""
    s = where(t.sales, date_range("date", from_, to_))
    g = (s.groupBy(F.coalesce("payment_method", F.lit("unknown")).alias("payment_method"),
                   F.coalesce("payment_type", F.lit("unknown")).alias("payment_type"))
         .agg(F.count(F.lit(1)).alias("sale_count"), F.sum("total_amount").alias("amount")))
    total = g.agg(F.sum("amount").alias("_total"))  # one row over the few groups
    out = g.crossJoin(total)
    share = F.when(F.col("_total") != 0,
                   F.col("amount").cast("double") / F.col("_total").cast("double"))
    return out.select("payment_method", "payment_type", "sale_count", _dbl("amount"), share.alias("share")
                      ).orderBy(F.desc("amount"), "payment_method", "payment_type")


# ---------------------------------------------------------------- A22
def top_products(t: Tables, from_=None, to_=None, n: int = 10) -> DataFrame:
    """The n best products by revenue; ties by code, then id (top-k, no global sort)."""
    return (sales_by_product(t, from_, to_)
            .orderBy(F.desc_nulls_last("total_amount"), F.asc_nulls_last("code"), F.asc("product_id"))
            .limit(n))


# ---------------------------------------------------------------- A23 / A31
def _actual(t: Tables, from_, to_) -> DataFrame:
    actual = (where(t.sales.select("salesperson_id", "date", "total_amount"), date_range("date", from_, to_))
              .groupBy("salesperson_id").agg(F.sum("total_amount").alias("actual")))
    sp = t.salespersons.filter(F.col("is_active") == 1).select(
        F.col("id").alias("salesperson_id"), F.col("name").alias("salesperson_name"),
        "target_amount", "commission_rate")
    return sp.join(actual, "salesperson_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))


def target_vs_actual(t: Tables, from_=None, to_=None) -> DataFrame:
    """Target, actual and achievement % (NULL when the target is 0)."""
    a = _actual(t, from_, to_)
    pct = F.when(F.col("target_amount") != 0,
                 F.col("actual").cast("double") * F.lit(100.0) / F.col("target_amount").cast("double"))
    return a.select("salesperson_id", "salesperson_name", _dbl("target_amount"), _dbl("actual"),
                    pct.alias("achievement_pct")).orderBy(F.desc("actual"), "salesperson_id")


def commission(t: Tables, from_=None, to_=None) -> DataFrame:
    """commission = actual × rate / 100 (rate read as a percent)."""
    a = _actual(t, from_, to_)
    return a.select("salesperson_id", "salesperson_name", "commission_rate", _dbl("actual"),
                    (F.col("actual").cast("double") * F.col("commission_rate") / F.lit(100.0)).alias("commission")
                    ).orderBy(F.desc("commission"), "salesperson_id")


# ---------------------------------------------------------------- A24
def inventory_value(t: Tables) -> DataFrame:
    """Warehouse value of active products, rolled up product → category → all."""
    p = t.products.filter(F.col("is_active") == 1).select(
        category_key().alias("category"), "code", "stock_quantity",
        (F.col("stock_quantity") * F.col("unit_price")).alias("_value"))
    return (p.rollup("category", "code")
            .agg(F.sum("stock_quantity").alias("units"), F.sum("_value").alias("value"),
                 F.grouping_id().alias("level"))
            .select("category", "code", "units", _dbl("value"), "level")
            .orderBy("level", "category", "code"))


# ---------------------------------------------------------------- A25..A28
def _with_total(detail: DataFrame, sums: dict[str, str], counts_name: str = "row_count",
                facts: DataFrame | None = None) -> DataFrame:
    """Detail rows plus one grand-total row (``is_total`` = 1).

    The total is a global partial/final aggregate unioned to the detail:
    cheaper than GROUPING SETS, which would shuffle every detail row.  It is
    taken from ``facts``, the detail before its names are joined: names are looked
    up by unique keys (C4) and neither add nor drop rows, so every join runs once."""
    total = (detail if facts is None else facts).agg(F.count(F.lit(1)).alias(counts_name),
                       *[F.sum(c).alias(out) for out, c in sums.items()])
    det = detail.select("*", F.lit(1).cast("bigint").alias(counts_name), F.lit(0).alias("is_total"))
    return det.unionByName(total.withColumn("is_total", F.lit(1)), allowMissingColumns=True)


def sales_report(t: Tables, **filters) -> DataFrame:
    """Filtered sales with names, plus a grand-total row."""
    from .listings import sale_names, sales_filtered
    s = sales_filtered(t, **filters)
    d = sale_names(s, t).select(
        "id", "date", "shop_name", "salesperson_name", "route_name", "payment_type",
        "total_amount", "paid_amount", "balance_amount")
    out = _with_total(d, {"total_amount": "total_amount", "paid_amount": "paid_amount",
                          "balance_amount": "balance_amount"}, facts=s)
    return out.select("id", "date", "shop_name", "salesperson_name", "route_name", "payment_type",
                      _dbl("total_amount"), _dbl("paid_amount"), _dbl("balance_amount"), "row_count", "is_total")


def collections_report(t: Tables, **filters) -> DataFrame:
    """Filtered collections with names, plus a grand-total row."""
    from .listings import collection_names, collections_filtered
    c = collections_filtered(t, **filters)
    d = collection_names(c, t).select("id", "date", "shop_name", "salesperson_name", "payment_method", "amount")
    out = _with_total(d, {"amount": "amount"}, facts=c)
    return out.select("id", "date", "shop_name", "salesperson_name", "payment_method", _dbl("amount"),
                      "row_count", "is_total")


def issues_report(t: Tables, **filters) -> DataFrame:
    """Filtered issues with units and value (quantity × unit price), plus a total row.

    Search and value need the joined names and prices, so the detail is staged
    once as a table and the total reads two of its columns."""
    from .listings import issues_filtered
    d = issues_filtered(t, **filters).select(
        "date", "salesperson_id", "salesperson_name", "product_id", "product_code", "product_name",
        F.col("quantity_issued").alias("units"), (F.col("quantity_issued") * F.col("unit_price")).alias("value"))
    out = _with_total(materialize(d, "issues-report"), {"units": "units", "value": "value"})
    return out.select("date", "salesperson_id", "salesperson_name", "product_id", "product_code", "product_name",
                      "units", _dbl("value"), "row_count", "is_total")


def returns_report(t: Tables, **filters) -> DataFrame:
    """Returns by reason and condition (units, value), rolled up to a grand total."""
    from .listings import returns_filtered
    d = returns_filtered(t, **filters).select(
        "reason", "condition", "quantity_returned", (F.col("quantity_returned") * F.col("unit_price")).alias("_v"))
    return (d.rollup("reason", "condition")
            .agg(F.count(F.lit(1)).alias("return_count"), F.sum("quantity_returned").alias("units"),
                 F.sum("_v").alias("value"), F.grouping_id().alias("level"))
            .select("reason", "condition", "return_count", "units", _dbl("value"), "level")
            .orderBy("level", "reason", "condition"))


# ---------------------------------------------------------------- A29
def sales_by_location(t: Tables, from_=None, to_=None) -> DataFrame:
    """Revenue rolled up district → town → route from the shop's location.

    Sales are reduced per shop first, so the join to shops and the rollup
    work on one row per shop, not per sale."""
    per_shop = (where(t.sales.select("shop_id", "date", "total_amount"), date_range("date", from_, to_))
                .groupBy("shop_id").agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("n")))
    loc = t.shops.select(F.col("id").alias("shop_id"), "district_id", "town_id", "route_id")
    g = (per_shop.join(loc, "shop_id", "left")
         .rollup("district_id", "town_id", "route_id")
         .agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("sale_count"), F.grouping_id().alias("level")))
    out = _names(g, t.districts, "district_id", district_name="name")
    out = _names(out, t.towns, "town_id", town_name="name")
    out = _names(out, t.routes, "route_id", route_name="name")
    return out.select("level", "district_id", "district_name", "town_id", "town_name", "route_id", "route_name",
                      _dbl("revenue"), "sale_count").orderBy("level", "district_id", "town_id", "route_id")


# ---------------------------------------------------------------- A30
def stock_overview(t: Tables) -> DataFrame:
    """Per product warehouse units, field units, total and value."""
    field = t.salesperson_stock.groupBy("product_id").agg(F.sum("quantity").alias("field_units"))
    p = t.products.select("id", "code", "name", "is_active", "stock_quantity", "unit_price")
    out = p.join(field.withColumnRenamed("product_id", "id"), "id", "left")
    fu = F.coalesce("field_units", F.lit(0)).cast("bigint")
    total = F.col("stock_quantity") + fu
    return out.select("id", "code", "name", "is_active", F.col("stock_quantity").alias("warehouse_units"),
                      fu.alias("field_units"), total.alias("total_units"),
                      _dbl("value", total * F.col("unit_price"))).orderBy("code", "id")
