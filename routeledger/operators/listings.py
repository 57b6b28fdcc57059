"""J1..J15 enriched listings and T1..T5 ordering, paging and top-k.

Dimension names are attached with equi LEFT joins on the foreign key.
No join carries a broadcast hint: the planner broadcasts a dimension only
when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(AQE re-checks at runtime), and falls back to a shuffle join beyond it.
Listings are lazily ordered; a page or top-k becomes a
``TakeOrderedAndProject`` (per-partition top-k, then a small merge),
never a full global sort of the fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import date_range, filter_returns, filter_shops, lookup, search_movements, where
from ..functions.scalars import as_date, day_of, to_double
from ..tables import Tables
from .reports import _names, shops_located


def _dbl(name: str, col: Column | None = None) -> Column:
    return to_double(col if col is not None else F.col(name)).alias(name)


# ---------------------------------------------------------------- J1..J5
def shops_enriched(t: Tables, route_id=None, district_id=None, town_id=None, active: bool = True,
                   ordered: bool = True) -> DataFrame:
    """Shops with district, town and route names, filtered by location."""
    s = filter_shops(t.shops, route_id=route_id, district_id=district_id, town_id=town_id, active=active)
    out = shops_located(s.select("id", "code", "name", "owner_name", "contact_number", "district_id", "town_id",
                                 "route_id", "credit_limit", "current_balance", "is_active"), t)
    out = out.select("id", "code", "name", "owner_name", "contact_number", "district_id", "town_id", "route_id",
                     _dbl("credit_limit"), _dbl("current_balance"), "is_active",
                     "district_name", "town_name", "route_name")
    return out.orderBy("name", "id") if ordered else out


def shop_detail(t: Tables, ids) -> DataFrame:
    """J1 rows for a batch of shop ids, regardless of the active flag."""
    shops = t.with_tables(shops=lookup(t.shops, ids))
    return shops_enriched(shops, active=False)


def towns_enriched(t: Tables, ids=None) -> DataFrame:
    """Towns with their district name."""
    towns = t.towns if ids is None else lookup(t.towns, ids)
    out = _names(towns.select("id", "code", "name", "district_id"), t.districts, "district_id", district_name="name")
    return out.orderBy("name", "id")


def routes_enriched(t: Tables, ids=None) -> DataFrame:
    """Routes with town and district (two hops)."""
    routes = t.routes if ids is None else lookup(t.routes, ids)
    out = _names(routes.select("id", "code", "name", "town_id", "description"), t.towns, "town_id",
                 town_name="name", district_id="district_id")
    out = _names(out, t.districts, "district_id", district_name="name")
    return out.select("id", "code", "name", "description", "town_id", "town_name", "district_id",
                      "district_name").orderBy("name", "id")


def location_hierarchy(t: Tables) -> DataFrame:
    """Districts → towns → routes flattened; a level without children is kept."""
    d = t.districts.select(F.col("id").alias("district_id"), F.col("code").alias("district_code"),
                           F.col("name").alias("district_name"))
    tw = t.towns.select(F.col("id").alias("town_id"), F.col("code").alias("town_code"),
                        F.col("name").alias("town_name"), "district_id")
    r = t.routes.select(F.col("id").alias("route_id"), F.col("code").alias("route_code"),
                        F.col("name").alias("route_name"), "town_id")
    out = d.join(tw, "district_id", "left").join(r, "town_id", "left")
    return out.select("district_id", "district_code", "district_name", "town_id", "town_code", "town_name",
                      "route_id", "route_code", "route_name").orderBy(
        "district_name", "district_id", "town_name", "town_id", "route_name", "route_id")


# ---------------------------------------------------------------- J6..J8
SALE_COLS = ("id", "date", "shop_id", "salesperson_id", "route_id", "total_amount", "paid_amount",
             "balance_amount", "payment_type", "payment_method")


def sale_names(sales: DataFrame, t: Tables) -> DataFrame:
    out = _names(sales, t.shops, "shop_id", shop_name="name")
    out = _names(out, t.salespersons, "salesperson_id", salesperson_name="name")
    return _names(out, t.routes, "route_id", route_name="name")


def _sale_out(df: DataFrame) -> DataFrame:
    return df.select("id", "date", "shop_id", "salesperson_id", "route_id", _dbl("total_amount"),
                     _dbl("paid_amount"), _dbl("balance_amount"), "payment_type", "payment_method",
                     "shop_name", "salesperson_name", "route_name")


def sales_filtered(t: Tables, from_=None, to_=None, salesperson_id=None, shop_id=None, route_id=None) -> DataFrame:
    """Filtered sales, money still DECIMAL (shared by J6 and A25)."""
    return where(t.sales.select(*SALE_COLS), date_range("date", from_, to_),
                 None if salesperson_id is None else F.col("salesperson_id") == salesperson_id,
                 None if shop_id is None else F.col("shop_id") == shop_id,
                 None if route_id is None else F.col("route_id") == route_id)


def sales_enriched(t: Tables, from_=None, to_=None, salesperson_id=None, shop_id=None, route_id=None,
                   ordered: bool = True) -> DataFrame:
    """Sales with shop, salesperson and route names, newest first."""
    out = _sale_out(sale_names(sales_filtered(t, from_, to_, salesperson_id, shop_id, route_id), t))
    return out.orderBy(F.desc("date"), F.desc("id")) if ordered else out


def sale_items_detail(t: Tables, sale_ids) -> DataFrame:
    """J7 flat form: the items of the given sales with product name and code."""
    items = lookup(t.sale_items, sale_ids, "sale_id").select("sale_id", "product_id", "quantity", "unit_price",
                                                               "total_price")
    out = _names(items, t.products, "product_id", product_name="name", product_code="code")
    return out.select("sale_id", "product_id", "quantity", _dbl("unit_price"), _dbl("total_price"),
                      "product_name", "product_code")


def sale_detail(t: Tables, sale_ids) -> DataFrame:
    """Sale header with its items nested as ``array<struct>``.

    Items are grouped per sale (one shuffle on sale_id) and sorted inside
    each sale; the array is as long as one sale's lines."""
    items = sale_items_detail(t, sale_ids)
    nested = (items.groupBy("sale_id")
              .agg(F.sort_array(F.collect_list(F.struct("product_id", "quantity", "unit_price", "total_price",
                                                        "product_name", "product_code"))).alias("items")))
    headers = _sale_out(sale_names(lookup(t.sales.select(*SALE_COLS), sale_ids), t))
    out = headers.join(nested.withColumnRenamed("sale_id", "id"), "id", "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(nested.schema["items"].dataType)))


def collections_filtered(t: Tables, from_=None, to_=None, shop_id=None, salesperson_id=None, ids=None) -> DataFrame:
    """Filtered collections, money still DECIMAL (shared by J8 and A26)."""
    c = t.collections.select("id", "date", "shop_id", "salesperson_id", "amount", "payment_method",
                             "reference_number", "notes")
    if ids is not None:
        c = lookup(c, ids)
    return where(c, date_range("date", from_, to_),
                 None if shop_id is None else F.col("shop_id") == shop_id,
                 None if salesperson_id is None else F.col("salesperson_id") == salesperson_id)


def collection_names(c: DataFrame, t: Tables) -> DataFrame:
    out = _names(c, t.shops, "shop_id", shop_name="name")
    return _names(out, t.salespersons, "salesperson_id", salesperson_name="name")


def collections_enriched(t: Tables, from_=None, to_=None, shop_id=None, salesperson_id=None, ids=None,
                         ordered: bool = True) -> DataFrame:
    """Collections with shop and salesperson names, newest first."""
    out = collection_names(collections_filtered(t, from_, to_, shop_id, salesperson_id, ids), t).select(
        "id", "date", "shop_id", "salesperson_id", _dbl("amount"), "payment_method",
        "reference_number", "notes", "shop_name", "salesperson_name")
    return out.orderBy(F.desc("date"), F.desc("id")) if ordered else out


# ---------------------------------------------------------------- J9 / J10
def _movement_names(df: DataFrame, t: Tables) -> DataFrame:
    out = _names(df, t.salespersons, "salesperson_id", salesperson_name="name", salesperson_code="code")
    return _names(out, t.products, "product_id", product_name="name", product_code="code", unit="unit",
                  unit_price="unit_price")


ISSUE_SEARCH = ("product_name", "product_code", "salesperson_name", "salesperson_code", "vehicle_number")
RETURN_SEARCH = ("product_name", "product_code", "salesperson_name", "salesperson_code", "notes")


def issues_filtered(t: Tables, from_=None, to_=None, salesperson_id=None, product_id=None,
                    search: str | None = None) -> DataFrame:
    """Shared predicate builder of J9 (listing) and A14 (count)."""
    i = where(t.stock_issues.select("id", "date", "salesperson_id", "product_id", "quantity_issued",
                                    "vehicle_number", "notes"),
              date_range("date", from_, to_),
              None if salesperson_id is None else F.col("salesperson_id") == salesperson_id,
              None if product_id is None else F.col("product_id") == product_id)
    return search_movements(_movement_names(i, t), search, ISSUE_SEARCH)


def returns_filtered(t: Tables, from_=None, to_=None, salesperson_id=None, product_id=None, reason=None,
                     condition=None, search: str | None = None) -> DataFrame:
    """Shared predicate builder of J10 (listing) and A15 (count)."""
    r = t.stock_returns.select("id", "date", "salesperson_id", "product_id", "quantity_returned", "reason",
                               "condition", "inspection_required", "notes")
    r = filter_returns(where(r, date_range("date", from_, to_)), reason=reason, condition=condition,
                       salesperson_id=salesperson_id, product_id=product_id)
    return search_movements(_movement_names(r, t), search, RETURN_SEARCH)


ISSUE_ORDER = ("date", "salesperson_id", "product_id", "quantity_issued", "vehicle_number", "id")
RETURN_ORDER = ("date", "salesperson_id", "product_id", "quantity_returned", "reason", "condition", "notes", "id")


def _newest_first(cols) -> list[Column]:
    # Newest first, then every remaining column: a total order even when
    # the movement rows carry no id.
    return [F.desc_nulls_last(cols[0])] + [F.asc_nulls_last(c) for c in cols[1:]]


def issues_enriched(t: Tables, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    """Issues with salesperson and product attributes, search and paging."""
    i = issues_filtered(t, **filters).select(
        "id", "date", "salesperson_id", "product_id", "quantity_issued", "vehicle_number", "notes",
        "salesperson_name", "salesperson_code", "product_name", "product_code", "unit", _dbl("unit_price"))
    return page(i, _newest_first(ISSUE_ORDER), limit, offset)


def returns_enriched(t: Tables, limit: int | None = None, offset: int | None = None, **filters) -> DataFrame:
    """Returns with the same attributes plus reason/condition."""
    r = returns_filtered(t, **filters).select(
        "id", "date", "salesperson_id", "product_id", "quantity_returned", "reason", "condition",
        "inspection_required", "notes", "salesperson_name", "salesperson_code", "product_name", "product_code",
        "unit", _dbl("unit_price"))
    return page(r, _newest_first(RETURN_ORDER), limit, offset)


# ---------------------------------------------------------------- J11..J15
def salesperson_with_stock(t: Tables, ids) -> DataFrame:
    """One row per (active salesperson, product held); none held → one row of NULLs."""
    sp = lookup(t.salespersons, ids).filter(F.col("is_active") == 1).select(
        F.col("id").alias("salesperson_id"), F.col("code").alias("salesperson_code"),
        F.col("name").alias("salesperson_name"), "vehicle_number")
    ss = t.salesperson_stock.select("salesperson_id", "product_id", F.col("quantity").alias("stock_quantity"))
    out = sp.join(ss, "salesperson_id", "left")
    out = _names(out, t.products, "product_id", product_name="name", product_code="code", unit_price="unit_price")
    return out.select("salesperson_id", "salesperson_code", "salesperson_name", "vehicle_number", "product_id",
                      "stock_quantity", "product_name", "product_code", _dbl("unit_price"))


def field_stock(t: Tables, ids) -> DataFrame:
    """Positive stock of active products held by the given salespersons, with line value."""
    ss = lookup(t.salesperson_stock, ids, "salesperson_id").filter(F.col("quantity") > 0).select(
        "salesperson_id", "product_id", "quantity")
    p = t.products.filter(F.col("is_active") == 1).select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("code").alias("product_code"),
        "unit_price", "unit")
    out = ss.join(p, "product_id")  # WHERE on the product side: an inner join (Q10)
    return out.select("salesperson_id", "product_id", "quantity", "product_name", "product_code", _dbl("unit_price"),
                      "unit", _dbl("value", F.col("quantity") * F.col("unit_price"))
                      ).orderBy("salesperson_id", "product_name", "product_id")


def stock_available(t: Tables, pairs: DataFrame) -> DataFrame:
    """Field quantity for (salesperson_id, product_id) pairs, 0 when absent."""
    p = pairs.select("salesperson_id", "product_id").distinct()
    ss = t.salesperson_stock.select("salesperson_id", "product_id", "quantity")
    out = p.join(ss, ["salesperson_id", "product_id"], "left")
    return out.select("salesperson_id", "product_id", F.coalesce("quantity", F.lit(0)).alias("quantity"))


def shops_with_credit(t: Tables) -> DataFrame:
    """Shops with a credit limit, names, available credit (Q9) and headroom."""
    s = t.shops.filter(F.col("credit_limit") > 0).select(
        "id", "code", "name", "owner_name", "district_id", "town_id", "route_id", "credit_limit",
        "current_balance", "is_active")
    out = shops_located(s, t)
    return out.select("id", "code", "name", "owner_name", "is_active", _dbl("credit_limit"), _dbl("current_balance"),
                      "district_name", "town_name", "route_name",
                      _dbl("available_credit", F.col("current_balance") - F.col("credit_limit")),
                      _dbl("headroom", F.col("credit_limit") + F.least(F.col("current_balance"), F.lit(0)))
                      ).orderBy("available_credit", "name", "id")


def sales_today_by_salesperson(t: Tables, as_of) -> DataFrame:
    """Active salespersons with the day's paid total and count (0 when idle)."""
    day = as_date(as_of)
    today = (t.sales.filter(day_of("date") == day).groupBy("salesperson_id")
             .agg(F.sum(F.coalesce("paid_amount", F.lit(0))).alias("total_sales"),
                  F.count("id").alias("sale_count")))
    sp = t.salespersons.filter(F.col("is_active") == 1).select(
        F.col("id").alias("salesperson_id"), "code", "name", "vehicle_number")
    out = sp.join(today, "salesperson_id", "left")
    return out.select("salesperson_id", "code", "name", "vehicle_number",
                      _dbl("total_sales", F.coalesce("total_sales", F.lit(0))),
                      F.coalesce("sale_count", F.lit(0)).alias("sale_count")).orderBy("name", "salesperson_id")


# ---------------------------------------------------------------- T1..T5
# Per-table ORDER BY allow-list of the generic listing.
ORDER_COLUMNS = {
    "products": ["id", "name", "code", "unit_price", "stock_quantity", "created_at", "category"],
    "salespersons": ["id", "name", "code", "created_at", "contact_number"],
    "shops": ["id", "name", "code", "current_balance", "created_at", "owner_name"],
    "sales": ["id", "date", "total_amount", "shop_id", "salesperson_id"],
    "sale_items": ["id", "sale_id", "product_id", "quantity"],
    "collections": ["id", "date", "amount", "shop_id", "salesperson_id"],
    "districts": ["id", "name", "code"],
    "towns": ["id", "name", "code", "district_id"],
    "routes": ["id", "name", "code", "town_id"],
    "salesperson_stock": ["id", "salesperson_id", "product_id", "quantity"],
    "stock_issues": ["id", "date", "salesperson_id", "product_id"],
    "stock_returns": ["id", "date", "salesperson_id", "product_id"],
}
MAX_LISTING = 1000


def _order(column: str, direction: str) -> Column:
    d = direction.upper()
    if d not in ("ASC", "DESC"):
        raise ValueError(f"invalid ORDER BY direction: {direction}")
    # NULLs first ascending, last descending (Q12), spelled out.
    return F.asc_nulls_first(column) if d == "ASC" else F.desc_nulls_last(column)


def ordered(df: DataFrame, table: str, column: str = "id", direction: str = "DESC") -> DataFrame:
    """Single-column order restricted to the table's allow-list; id breaks ties."""
    if column not in ORDER_COLUMNS.get(table, ["id"]):
        raise ValueError(f"invalid ORDER BY column: {column}")
    keys = [_order(column, direction)]
    if column != "id":
        keys.append(_order("id", direction))
    return df.orderBy(*keys)


def clamp_limit(limit) -> int:
    """Q14: 1..1000; 0, NaN or garbage → 1000; negative → 1."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        n = 0
    return min(max(1, n or MAX_LISTING), MAX_LISTING)


def list_records(t: Tables, table: str, equals: dict | None = None, order_by: str = "id DESC",
                 limit=None, offset=0, clamp: bool = False) -> DataFrame:
    """Generic filtered listing of one of the twelve allowed tables.

    All rows unless a ``limit`` above 0 is given; ``clamp`` asks for the interactive rule
    (1..1000 rows, ``clamp_limit``)."""
    from ..functions.predicates import filter_equals
    if table not in ORDER_COLUMNS:
        raise ValueError(f"invalid table name: {table}")
    parts = order_by.strip().split()
    column, direction = parts[0], (parts[1] if len(parts) > 1 else "DESC")
    df = filter_equals(t.get(table), equals or {})
    df = ordered(df, table, column, direction)
    try:
        off = max(0, int(offset))
    except (TypeError, ValueError):
        off = 0
    if off > 0:
        df = df.offset(off)
    if clamp:
        return df.limit(clamp_limit(limit))
    return df.limit(int(limit)) if limit and int(limit) > 0 else df


def page(df: DataFrame, order: list, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of an ordered listing; offset alone is allowed (Q15).

    An offset without a limit numbers the rows by ranges (``dense_ids``) instead of
    passing all of them through one task.  For deep pages prefer ``keyset_page``."""
    if offset and not limit and all(isinstance(c, str) for c in order):
        from ..functions.windows import dense_ids
        return dense_ids(df, order, 0, "_row").filter(F.col("_row") > int(offset)).drop("_row").orderBy(*order)
    out = df.orderBy(*order)
    if offset:
        out = out.offset(int(offset))
    if limit:
        out = out.limit(int(limit))
    return out


def keyset_page(df: DataFrame, order: list[str], limit: int, after: dict | None = None, descending: bool = False) -> DataFrame:
    """T3 by key: the ``limit`` rows that follow the row with the key ``after`` (column -> value) in ``order``.

    The filter reaches the scan and the page is a top-k, however deep it lies.
    ``order`` must be a unique key without NULLs."""
    if after is not None:
        passed = F.lit(False)
        for i, c in enumerate(order):
            beyond = F.col(c) < F.lit(after[c]) if descending else F.col(c) > F.lit(after[c])
            for e in order[:i]:
                beyond = beyond & (F.col(e) == F.lit(after[e]))
            passed = passed | beyond
        df = df.filter(passed)
    return df.orderBy(*[F.desc(c) if descending else F.asc(c) for c in order]).limit(limit)


def recent_sales(t: Tables, n: int = 10) -> DataFrame:
    """T4: newest n sales; the top-k runs before the dimension joins."""
    top = t.sales.select(*SALE_COLS).orderBy(F.desc("date"), F.desc("id")).limit(n)
    return _sale_out(sale_names(top, t)).orderBy(F.desc("date"), F.desc("id"))


def products_by_name(t: Tables, active_only: bool = True) -> DataFrame:
    """T5: products ordered by name."""
    p = t.products.filter(F.col("is_active") == 1) if active_only else t.products
    return p.orderBy("name", "id")


def districts_by_name(t: Tables) -> DataFrame:
    """T5: districts ordered by name."""
    return t.districts.orderBy("name", "id")

