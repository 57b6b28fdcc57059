"""Registered ledger (L1, L2, L6..L12) and check (C1..C8) queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import ledger as G
from ..operators.activity import movements
from .catalog import AS_OF, _d, _m, register
from .oracle_base import sql
from .q_listings import _MOVES, MOVE_TABLES


def _lv(df, col="level"):
    return df.withColumn(col, F.col(col).cast("double"))


_STATE = """
select 'warehouse' as resource, id as k1, cast(-1 as bigint) as k2, cast(stock_quantity as decimal(18,2)) as level
  from products
union all select 'field', salesperson_id, product_id, cast(quantity as decimal(18,2)) from salesperson_stock
union all select 'debt', id, -1, cast(-current_balance as decimal(18,2)) from shops
"""
STATE_TABLES = ("products", "salesperson_stock", "shops")


@register("positions", "L1", sql(f"""select resource, k1, k2, cast(sum(delta) as double) as level
from ({_MOVES}) m group by resource, k1, k2""", *MOVE_TABLES))
def _l1(t):
    return _lv(G.positions(t))


@register("positions_as_of", "L1", sql(f"""
select coalesce(o.resource, m.resource) as resource, coalesce(o.k1, m.k1) as k1, coalesce(o.k2, m.k2) as k2,
  cast(coalesce(o.level, 0) + coalesce(m.moved, 0) as double) as level
from ({_STATE}) o
full outer join (select resource, k1, k2, sum(delta) as moved from ({_MOVES}) mv
                 where cast(ts as date) <= {_d(AS_OF)} group by 1, 2, 3) m
  on o.resource = m.resource and o.k1 = m.k1 and o.k2 = m.k2""", *MOVE_TABLES, "products", "salesperson_stock",
                                       "shops"))
def _l1b(t):
    return _lv(G.positions(t, AS_OF, opening=G.state_levels(t)))


@register("shop_statement", "L2", sql(f"""select k1 as shop_id, ts, source, source_id, cast(delta as double) as delta,
  cast(sum(delta) over (partition by k1 order by ts, source, source_id
                        rows between unbounded preceding and current row) as double) as running_debt
from ({_MOVES}) m where resource = 'debt'""", *MOVE_TABLES))
def _l2(t):
    return G.shop_statement(t)


@register("apply_levels", "L6", sql(f"""
with d as (select resource, k1, k2, sum(delta) as d from ({_MOVES}) m group by 1, 2, 3)
select 'warehouse' as resource, p.id as k1, cast(-1 as bigint) as k2,
  cast(p.stock_quantity + coalesce(d.d, 0) as double) as level
from products p left join d on d.resource = 'warehouse' and d.k1 = p.id
union all
select 'field', coalesce(ss.salesperson_id, f.k1), coalesce(ss.product_id, f.k2),
  cast(coalesce(ss.quantity, 0) + coalesce(f.d, 0) as double)
from salesperson_stock ss full outer join (select * from d where resource = 'field') f
  on ss.salesperson_id = f.k1 and ss.product_id = f.k2
union all
select 'debt', s.id, -1, cast(-(s.current_balance - coalesce(d.d, 0)) as double)
from shops s left join d on d.resource = 'debt' and d.k1 = s.id""", *MOVE_TABLES, "products", "salesperson_stock",
                                    "shops"))
def _l6(t):
    deltas = movements(t).select("resource", "k1", "k2", "delta")
    return _lv(G.state_levels(G.apply_levels(t, deltas)))


@register("append_collections", "L7", sql("""
select id, date, shop_id, salesperson_id, cast(amount as double) as amount, payment_method from collections
union all
select (select max(id) from collections) + row_number() over (order by date, shop_id, id), date, shop_id,
  salesperson_id, cast(balance_amount as double), 'cash'
from sales where balance_amount > 0""", "collections", "sales"))
def _l7(t):
    base = t.collections.select("id", "date", "shop_id", "salesperson_id", "amount", "payment_method")
    new = t.sales.filter(F.col("balance_amount") > 0).select(
        F.col("id").alias("src_id"), "date", "shop_id", "salesperson_id", F.col("balance_amount").alias("amount"),
        F.lit("cash").alias("payment_method"))
    return _lv(G.append_facts(base, new, ["date", "shop_id", "src_id"]), "amount")


@register("merge_products", "L8", sql("""
select p.id, p.code, cast(case when u.id is not null then u.unit_price else p.unit_price end as double) as unit_price,
  case when u.id is not null then u.min_stock_level else p.min_stock_level end as min_stock_level
from products p left join (select id, unit_price + 1 as unit_price, min_stock_level * 2 as min_stock_level
                           from products where lower(category) = 'promo') u on p.id = u.id""", "products"))
def _l8(t):
    upd = t.products.filter(F.lower("category") == "promo").select(
        "id", F.expr("unit_price + 1").alias("unit_price"), (F.col("min_stock_level") * 2).alias("min_stock_level"))
    out = G.merge_records(t.products, upd)
    return out.select("id", "code", F.col("unit_price").cast("double").alias("unit_price"), "min_stock_level")


_PRODUCT_USE = """((select count(*) from sale_items x where x.product_id = p.id) > 0
   or (select count(*) from stock_issues x where x.product_id = p.id) > 0
   or (select count(*) from stock_returns x where x.product_id = p.id) > 0)"""


@register("delete_products_outcome", "L9", sql(f"""
select p.id, case when {_PRODUCT_USE} then 'soft' else 'hard' end as action, cast(null as varchar) as reason
from products p where p.is_active = 0""", "products", "sale_items", "stock_issues", "stock_returns"))
def _l9(t):
    return G.delete_outcome(t, "product", t.products.filter(F.col("is_active") == 0).select("id"))


@register("delete_products_stock_after", "L9", sql(f"""
select ss.salesperson_id, ss.product_id, ss.quantity from salesperson_stock ss
where ss.product_id not in (select p.id from products p where p.is_active = 0 and not {_PRODUCT_USE})""",
                                                   "products", "sale_items", "stock_issues", "stock_returns",
                                                   "salesperson_stock"))
def _l9s(t):
    after, _ = G.delete_records(t, "product", t.products.filter(F.col("is_active") == 0).select("id"))
    return after.salesperson_stock.select("salesperson_id", "product_id", "quantity")


@register("delete_shops_outcome", "L9", sql("""
select s.id, case when u.sales + u.colls > 0 then 'refused' else 'deleted' end as action,
  case when u.sales + u.colls > 0 then concat_ws(', ', case when u.sales > 0 then 'has sales' end,
                                                 case when u.colls > 0 then 'has collections' end) end as reason
from shops s join (select s2.id, (select count(*) from sales x where x.shop_id = s2.id) as sales,
                          (select count(*) from collections x where x.shop_id = s2.id) as colls from shops s2) u
  on s.id = u.id
where s.is_active = 0""", "shops", "sales", "collections"))
def _l9b(t):
    return G.delete_outcome(t, "shop", t.shops.filter(F.col("is_active") == 0).select("id"))


def _messy_towns(t):
    """Town rows as a user might type them: padded, lower-case codes and
    district ids that are sometimes blank or not numbers."""
    did = F.col("district_id").cast("string")
    return t.towns.select(
        F.concat(F.lit(" "), F.lower("code"), F.lit(" ")).alias("code"),
        F.concat(F.lit("  "), F.col("name"), F.lit(" ")).alias("name"),
        F.when(F.col("id") % 6 == 5, F.concat(F.lit("r"), did)).when(F.col("id") % 6 == 4, F.lit(" "))
         .otherwise(did).alias("district_id"))


_MESSY_TOWNS = """(select concat(' ', lower(code), ' ') as code, concat('  ', name, ' ') as name,
  case when id % 6 = 5 then concat('r', cast(district_id as varchar)) when id % 6 = 4 then ' '
       else cast(district_id as varchar) end as district_id from towns) raw"""


@register("normalise_towns", "L10", sql(f"""
select upper(trim(code)) as code, trim(name) as name, try_cast(trim(district_id) as bigint) as district_id
from {_MESSY_TOWNS}
where trim(code) <> '' and trim(name) <> '' and trim(district_id) <> ''
  and try_cast(trim(district_id) as bigint) is not null""", "towns"))
def _l10(t):
    good, _ = G.normalise_master(_messy_towns(t), "town")
    return good


@register("normalise_towns_rejected", "L10", sql(f"""
select upper(trim(code)) as code, trim(name) as name, try_cast(trim(district_id) as bigint) as district_id,
  case when trim(district_id) = '' then 'district_id is required' else 'district_id is not an integer' end as reason
from {_MESSY_TOWNS}
where trim(district_id) = '' or try_cast(trim(district_id) as bigint) is null""", "towns"))
def _l10b(t):
    _, bad = G.normalise_master(_messy_towns(t), "town")
    return bad


def _mapping(t):
    spark = t.products.sparkSession
    # Parameter: rename one category, delete another.
    return spark.createDataFrame([("PROMO", "promotion"), ("small", None)], "old_value string, new_value string")


@register("recategorise_products", "L11", sql("""
select id, case when lower(coalesce(category, 'general')) = 'promo' then 'promotion'
                when lower(coalesce(category, 'general')) = 'small' then 'general' else category end as category
from products""", "products"))
def _l11(t):
    return G.recategorise(t, _mapping(t)).products.select("id", "category")


@register("recategorise_categories", "L11", sql("""
select id, code, case when lower(value) = 'promo' then 'promotion' else value end as value, name
from product_categories where lower(value) <> 'small'""", "product_categories"))
def _l11c(t):
    return G.recategorise(t, _mapping(t)).product_categories.select("id", "code", "value", "name")


_RESTOCK = "(select product_id, sum(quantity_returned) as d from stock_returns group by product_id) d"


@register("restock_products", "L12", sql(f"""
select p.id, p.stock_quantity + cast(coalesce(case when p.is_active = 1 then d.d end, 0) as bigint) as stock_quantity
from products p left join {_RESTOCK} on p.id = d.product_id""", "products", "stock_returns"))
def _l12(t):
    deltas = t.stock_returns.select(F.col("product_id").alias("id"), F.col("quantity_returned").alias("delta"))
    new, _ = G.adjust_levels(t.products, deltas, "stock_quantity")
    return new.select("id", "stock_quantity")


@register("restock_rejects", "L12", sql(f"""
select d.product_id as id, cast(d.d as bigint) as delta,
  case when p.id is null then 'not found' else 'inactive' end as reason
from {_RESTOCK} left join products p on p.id = d.product_id
where p.id is null or p.is_active <> 1""", "products", "stock_returns"))
def _l12r(t):
    deltas = t.stock_returns.select(F.col("product_id").alias("id"), F.col("quantity_returned").alias("delta"))
    _, rejects = G.adjust_levels(t.products, deltas, "stock_quantity")
    return rejects


# ---------------------------------------------------------------- checks
@register("negative_stock", "C1", sql("""
select 'warehouse' as resource, id as k1, cast(-1 as bigint) as k2, cast(stock_quantity as double) as level
from products where stock_quantity < 0
union all
select 'field', salesperson_id, product_id, cast(quantity as double) from salesperson_stock where quantity < 0""",
                                      "products", "salesperson_stock"))
def _c1(t):
    return C.negative_stock(t)


@register("negative_positions", "C1", sql(f"""select resource, k1, k2, cast(sum(delta) as double) as level
from ({_MOVES}) m where resource in ('warehouse', 'field') group by resource, k1, k2 having sum(delta) < 0""",
                                          *MOVE_TABLES))
def _c1b(t):
    return C.negative_positions(t)


@register("first_negative", "C2", sql(f"""
with p as (select resource, k1, k2, ts, sum(delta) as d from ({_MOVES}) m group by 1, 2, 3, 4),
r as (select *, sum(d) over (partition by resource, k1, k2 order by ts
                            rows between unbounded preceding and current row) as run from p)
select resource, k1, k2, min(ts) as first_negative_ts, cast(arg_min(run, ts) as double) as level_then
from r where run < 0 group by 1, 2, 3""", *MOVE_TABLES))
def _c2(t):
    return C.first_negative(t)


def _orphans_sql() -> str:
    parts = []
    for child, col, parent in C.FOREIGN_KEYS:
        parts.append(f"""select '{child}' as "table", '{col}' as "column", {col} as value, count(*) as "rows"
from {child} where {col} is not null and {col} not in (select id from {parent} where id is not null)
group by {col}""")
    tables = sorted({c for c, _, _ in C.FOREIGN_KEYS} | {p for _, _, p in C.FOREIGN_KEYS})
    return sql("\nunion all\n".join(parts), *tables)


@register("orphan_keys", "C3", _orphans_sql())
def _c3(t):
    return C.orphan_keys(t)


_DUPES = """
select 'districts' as "table", 'code' as "columns", code as key, count(*) as "rows" from districts where code is not null group by code having count(*) > 1
union all select 'towns', 'code', code, count(*) from towns where code is not null group by code having count(*) > 1
union all select 'routes', 'code', code, count(*) from routes where code is not null group by code having count(*) > 1
union all select 'products', 'code', code, count(*) from products where code is not null group by code having count(*) > 1
union all select 'salespersons', 'code', code, count(*) from salespersons where code is not null group by code having count(*) > 1
union all select 'shops', 'code', code, count(*) from shops where code is not null group by code having count(*) > 1
union all select 'product_categories', 'code', code, count(*) from product_categories where code is not null
  group by code having count(*) > 1
union all select 'product_categories', 'value', value, count(*) from product_categories where value is not null
  group by value having count(*) > 1
union all select 'salesperson_stock', 'salesperson_id,product_id', salesperson_id || '|' || product_id, count(*)
  from salesperson_stock where salesperson_id is not null and product_id is not null
  group by salesperson_id, product_id having count(*) > 1
"""
_DUPE_T = ("districts", "towns", "routes", "products", "salespersons", "shops", "product_categories", "salesperson_stock")


@register("duplicate_keys", "C4", sql(_DUPES, *_DUPE_T))
def _c4(t):
    return C.duplicate_keys(t)


_INVALID = """
select 'sales' as "table", id as ref_id, 'total_amount missing' as rule from sales where total_amount is null
union all select 'sales', id, 'shop_id missing' from sales where shop_id is null
union all select 'sales', id, 'salesperson_id missing' from sales where salesperson_id is null
union all select 'sales', id, 'negative amount' from sales where paid_amount < 0 or balance_amount < 0
union all select 'sale_items', sale_id, 'quantity not positive' from sale_items where coalesce(not (quantity > 0), true)
union all select 'sale_items', sale_id, 'product_id missing' from sale_items where product_id is null
union all select 'collections', id, 'amount not positive' from collections where coalesce(not (amount > 0), true)
union all select 'collections', id, 'shop_id missing' from collections where shop_id is null
union all select 'collections', id, 'salesperson_id missing' from collections where salesperson_id is null
union all select 'stock_issues', cast(null as bigint), 'quantity not positive' from stock_issues
  where coalesce(not (quantity_issued > 0), true)
union all select 'stock_returns', cast(null as bigint), 'quantity not positive' from stock_returns
  where coalesce(not (quantity_returned > 0), true)"""
_INVALID_T = ("sales", "sale_items", "collections", "stock_issues", "stock_returns")


@register("invalid_facts", "C5", sql(_INVALID, *_INVALID_T))
def _c5(t):
    return C.invalid_facts(t)


# The checks on a bundle with flaws (projections of the same tables, alike here and in the SQL), so that they find something.
def _flawed(t):
    c = F.col
    hit = lambda n: c("id") % n == 0
    return t.with_tables(
        products=t.products.withColumn("code", F.when(hit(7), F.lit("TWICE")).when(hit(11), None).otherwise(c("code")))
        .withColumn("stock_quantity", F.when(hit(5), -c("stock_quantity") - 1).otherwise(c("stock_quantity"))),
        shops=t.shops.withColumn("code", F.when(hit(13), None).otherwise(c("code"))),
        sales=t.sales.withColumn("shop_id", F.when(hit(17), -c("id")).when(hit(19), None).otherwise(c("shop_id")))
        .withColumn("total_amount", F.when(hit(23), None).otherwise(c("total_amount")))
        .withColumn("paid_amount", F.when(hit(29), F.lit(-1)).otherwise(c("paid_amount")).cast("decimal(18,2)")),
        sale_items=t.sale_items.withColumn("quantity", F.when(c("sale_id") % 31 == 0, None).when(c("sale_id") % 37 == 0, 0).otherwise(c("quantity"))),
        collections=t.collections.withColumn("amount", F.when(hit(41), None).otherwise(c("amount")))
        .withColumn("salesperson_id", F.when(hit(43), F.lit(10 ** 9)).otherwise(c("salesperson_id"))),
        salesperson_stock=t.salesperson_stock.withColumn("product_id", F.when(c("product_id") % 3 == 0, F.lit(3)).otherwise(c("product_id"))))


_FLAWS = """
with _products as (select * replace (case when id % 7 = 0 then 'TWICE' when id % 11 = 0 then null else code end as code,
    case when id % 5 = 0 then -stock_quantity - 1 else stock_quantity end as stock_quantity) from products),
_shops as (select * replace (case when id % 13 = 0 then null else code end as code) from shops),
_sales as (select * replace (case when id % 17 = 0 then -id when id % 19 = 0 then null else shop_id end as shop_id,
    case when id % 23 = 0 then null else total_amount end as total_amount, case when id % 29 = 0 then -1 else paid_amount end as paid_amount) from sales),
_sale_items as (select * replace (case when sale_id % 31 = 0 then null when sale_id % 37 = 0 then 0 else quantity end as quantity) from sale_items),
_collections as (select * replace (case when id % 41 = 0 then null else amount end as amount,
    case when id % 43 = 0 then 1000000000 else salesperson_id end as salesperson_id) from collections),
_salesperson_stock as (select * replace (case when product_id % 3 = 0 then 3 else product_id end as product_id) from salesperson_stock)
"""


def _on_flaws(body: str) -> str:
    import re
    return _FLAWS + re.sub(r"(from|FROM) (products|shops|sales|sale_items|collections|salesperson_stock)\b", r"from _\2", body)


@register("flawed_negative_stock", "C1", sql(_on_flaws("""
select 'warehouse' as resource, id as k1, cast(-1 as bigint) as k2, cast(stock_quantity as double) as level
from products where stock_quantity < 0
union all
select 'field', salesperson_id, product_id, cast(quantity as double) from salesperson_stock where quantity < 0"""),
                                             "products", "shops", "sales", "sale_items", "collections", "salesperson_stock"))
def _c1f(t):
    return C.negative_stock(_flawed(t))


@register("flawed_orphan_keys", "C3", sql(_on_flaws("""
select 'sales' as "table", 'shop_id' as "column", shop_id as value, count(*) as "rows" from sales
  where shop_id is not null and not exists (select 1 from shops s where s.id = shop_id) group by shop_id
union all select 'collections', 'salesperson_id', salesperson_id, count(*) from collections
  where salesperson_id is not null and not exists (select 1 from salespersons p where p.id = salesperson_id) group by salesperson_id"""),
                                          "products", "shops", "sales", "sale_items", "collections", "salesperson_stock", "salespersons"))
def _c3f(t):
    return C.orphan_keys(_flawed(t))


@register("flawed_duplicate_keys", "C4", sql(_on_flaws(_DUPES), *_DUPE_T, "sales", "sale_items", "collections"))
def _c4f(t):
    return C.duplicate_keys(_flawed(t))


@register("flawed_invalid_facts", "C5", sql(_on_flaws(_INVALID), *_INVALID_T, "products", "shops", "salesperson_stock"))
def _c5f(t):
    return C.invalid_facts(_flawed(t))


@register("credit_breaches", "C6", sql(f"""
select id, code, name, {_m("-current_balance", "debt")}, {_m("credit_limit", "credit_limit")},
  {_m("-current_balance - credit_limit", "excess")}
from shops where -current_balance > credit_limit""", "shops"))
def _c6(t):
    return C.credit_breaches(t)


@register("reconcile", "C7", sql(f"""
with s as (select resource, k1, k2, sum(level) as s from ({_STATE}) st group by 1, 2, 3),
l as (select resource, k1, k2, sum(delta) as l from ({_MOVES}) m group by 1, 2, 3)
select coalesce(s.resource, l.resource) as resource, coalesce(s.k1, l.k1) as k1, coalesce(s.k2, l.k2) as k2,
  cast(coalesce(s.s, 0) as double) as stored, cast(coalesce(l.l, 0) as double) as ledger,
  cast(coalesce(s.s, 0) - coalesce(l.l, 0) as double) as difference
from s full outer join l on s.resource = l.resource and s.k1 = l.k1 and s.k2 = l.k2
where coalesce(s.s, 0) <> coalesce(l.l, 0)""", *MOVE_TABLES, "products", "salesperson_stock", "shops"))
def _c7(t):
    return C.reconcile(t)


@register("sale_mismatches", "C8", sql("""
select s.id, cast(s.total_amount as double) as total_amount, cast(coalesce(l.x, 0) as double) as lines_total,
  s.total_amount <> coalesce(l.x, 0) as lines_differ,
  coalesce(s.paid_amount, 0) + coalesce(s.balance_amount, 0) <> s.total_amount as split_differs
from sales s left join (select sale_id, sum(total_price) as x from sale_items group by sale_id) l on s.id = l.sale_id
where s.total_amount <> coalesce(l.x, 0)
   or coalesce(s.paid_amount, 0) + coalesce(s.balance_amount, 0) <> s.total_amount""", "sales", "sale_items"))
def _c8(t):
    return C.sale_mismatches(t)
