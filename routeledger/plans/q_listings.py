"""Registered listing, filter, paging and set-operation queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import activity as U
from ..operators import listings as L
from .catalog import CFROM, CTO, DAY, FROM, TO, _between, _d, _m, register
from .oracle_base import sql

_SHOP_COLS = """s.id, s.code, s.name, s.owner_name, cast(null as varchar) as contact_number, s.district_id, s.town_id,
  s.route_id, cast(s.credit_limit as double) as credit_limit, cast(s.current_balance as double) as current_balance,
  s.is_active, d.name as district_name, tw.name as town_name, r.name as route_name"""
_SHOP_FROM = """from shops s left join districts d on s.district_id = d.id left join towns tw on s.town_id = tw.id
  left join routes r on s.route_id = r.id"""
_LOC = ("shops", "districts", "towns", "routes")


@register("shops_enriched", "J1", sql(f"select {_SHOP_COLS} {_SHOP_FROM} where s.is_active = 1", *_LOC))
def _j1(t):
    return L.shops_enriched(t)


@register("shops_in_district", "F5", sql(f"select {_SHOP_COLS} {_SHOP_FROM} where s.district_id = 2", *_LOC))
def _f5(t):
    return L.shops_enriched(t, district_id=2, active=False)


@register("shop_detail", "J2", sql(f"""select {_SHOP_COLS} {_SHOP_FROM}
where s.id in (select shop_id from collections)""", *_LOC, "collections"))
def _j2(t):
    return L.shop_detail(t, t.collections.select("shop_id"))


@register("lookup_shops", "F7", sql("""select s.id, s.code, s.name from shops s
where s.id in (select shop_id from collections)""", "shops", "collections"))
def _f7(t):
    return P.lookup(t.shops, t.collections.select("shop_id")).select("id", "code", "name")


@register("towns_enriched", "J3", sql("""select tw.id, tw.code, tw.name, tw.district_id, d.name as district_name
from towns tw left join districts d on tw.district_id = d.id""", "towns", "districts"))
def _j3(t):
    return L.towns_enriched(t)


@register("routes_enriched", "J4", sql("""select r.id, r.code, r.name, cast(null as varchar) as description, r.town_id,
  tw.name as town_name, tw.district_id, d.name as district_name
from routes r left join towns tw on r.town_id = tw.id left join districts d on tw.district_id = d.id""",
                                       "routes", "towns", "districts"))
def _j4(t):
    return L.routes_enriched(t)


@register("location_hierarchy", "J5", sql("""select d.id as district_id, d.code as district_code, d.name as district_name,
  tw.id as town_id, tw.code as town_code, tw.name as town_name, r.id as route_id, r.code as route_code,
  r.name as route_name
from districts d left join towns tw on tw.district_id = d.id left join routes r on r.town_id = tw.id""",
                                          "districts", "towns", "routes"))
def _j5(t):
    return L.location_hierarchy(t)


_SALE_COLS = f"""s.id, s.date, s.shop_id, s.salesperson_id, s.route_id, {_m("s.total_amount", "total_amount")},
  {_m("s.paid_amount", "paid_amount")}, {_m("s.balance_amount", "balance_amount")}, s.payment_type, s.payment_method,
  sh.name as shop_name, sp.name as salesperson_name, r.name as route_name"""
_SALE_FROM = """from sales s left join shops sh on s.shop_id = sh.id left join salespersons sp on s.salesperson_id = sp.id
  left join routes r on s.route_id = r.id"""
_SALE_T = ("sales", "shops", "salespersons", "routes")


@register("sales_enriched", "J6", sql(f"select {_SALE_COLS} {_SALE_FROM} where {_between('s.date', FROM, TO)}",
                                      *_SALE_T))
def _j6(t):
    return L.sales_enriched(t, from_=FROM, to_=TO)


@register("sales_enriched_page", "T3", sql(f"""select {_SALE_COLS} {_SALE_FROM}
order by s.date desc nulls last, s.id desc nulls last limit 50 offset 100""", *_SALE_T))
def _t3(t):
    return L.page(L.sales_enriched(t, ordered=False), [F.desc_nulls_last("date"), F.desc_nulls_last("id")],
                  limit=50, offset=100)


@register("sales_of_salesperson", "F4", sql(f"""select {_SALE_COLS} {_SALE_FROM}
where s.salesperson_id = 7 and {_between('s.date', FROM, TO)}""", *_SALE_T))
def _f4(t):
    s = P.filter_sales(t.sales, salesperson_id=7, from_=FROM, to_=TO)
    return L._sale_out(L.sale_names(s.select(*L.SALE_COLS), t))


@register("sale_items_detail", "J7", sql(f"""select si.sale_id, si.product_id, si.quantity,
  cast(null as double) as unit_price, {_m("si.total_price", "total_price")}, p.name as product_name,
  p.code as product_code
from sale_items si left join products p on si.product_id = p.id
where si.sale_id in (select id from sales where {_between('date', FROM, TO)})""", "sale_items", "products", "sales"))
def _j7(t):
    return L.sale_items_detail(t, P.filter_dates(t.sales, "date", FROM, TO).select("id"))


@register("sale_detail", "J7", None)
def _j7n(t):
    return L.sale_detail(t, P.filter_dates(t.sales, "date", FROM, TO).select("id"))


@register("sale_detail_items", "J7", sql(f"""
select s.id, cast(count(i.sale_id) over (partition by s.id) as integer) as n_items,
  case when i.sale_id is not null then cast(row_number() over (partition by s.id order by i.product_id nulls first, i.quantity nulls first,
    i.total_price nulls first) - 1 as integer) end as pos, i.product_id, i.quantity, p.name as product_name
from sales s left join sale_items i on i.sale_id = s.id left join products p on p.id = i.product_id
where {_between("s.date", FROM, TO)}""", "sales", "sale_items", "products"))
def _j7i(t):
    d = L.sale_detail(t, P.filter_dates(t.sales, "date", FROM, TO).select("id"))
    return d.select("id", F.size("items").alias("n_items"), F.posexplode_outer("items").alias("pos", "it")).select(
        "id", "n_items", "pos", "it.product_id", "it.quantity", "it.product_name")


@register("collections_enriched", "J8", sql(f"""select c.id, c.date, c.shop_id, c.salesperson_id,
  {_m("c.amount", "amount")}, c.payment_method, cast(null as varchar) as reference_number,
  cast(null as varchar) as notes, sh.name as shop_name, sp.name as salesperson_name
from collections c left join shops sh on c.shop_id = sh.id left join salespersons sp on c.salesperson_id = sp.id
where {_between('c.date', CFROM, CTO)}""", "collections", "shops", "salespersons"))
def _j8(t):
    return L.collections_enriched(t, from_=CFROM, to_=CTO)


_ISSUE_COLS = """cast(null as bigint) as id, si.date, si.salesperson_id, si.product_id, si.quantity_issued,
  si.vehicle_number, cast(null as varchar) as notes, sp.name as salesperson_name, sp.code as salesperson_code,
  p.name as product_name, p.code as product_code, p.unit, cast(p.unit_price as double) as unit_price"""
_MOVE_FROM = """left join salespersons sp on {a}.salesperson_id = sp.id left join products p on {a}.product_id = p.id"""
ISSUE_TERM = "gear"


@register("issues_enriched", "J9", sql(f"""select {_ISSUE_COLS} from stock_issues si {_MOVE_FROM.format(a='si')}
where {_between('si.date', FROM, TO)} and (p.name ilike '%{ISSUE_TERM}%' or p.code ilike '%{ISSUE_TERM}%'
  or sp.name ilike '%{ISSUE_TERM}%' or sp.code ilike '%{ISSUE_TERM}%' or si.vehicle_number ilike '%{ISSUE_TERM}%')""",
                                       "stock_issues", "salespersons", "products"))
def _j9(t):
    return L.issues_enriched(t, from_=FROM, to_=TO, search=ISSUE_TERM)


@register("issues_page", "T3", sql(f"""select {_ISSUE_COLS} from stock_issues si {_MOVE_FROM.format(a='si')}
where {_between('si.date', FROM, TO)}
order by si.date desc nulls last, si.salesperson_id asc nulls last, si.product_id asc nulls last,
  si.quantity_issued asc nulls last, si.vehicle_number asc nulls last
limit 25 offset 50""", "stock_issues", "salespersons", "products"))
def _t3i(t):
    return L.issues_enriched(t, limit=25, offset=50, from_=FROM, to_=TO)


_RETURN_COLS = """cast(null as bigint) as id, sr.date, sr.salesperson_id, sr.product_id, sr.quantity_returned,
  sr.reason, sr.condition, sr.inspection_required, sr.notes, sp.name as salesperson_name, sp.code as salesperson_code,
  p.name as product_name, p.code as product_code, p.unit, cast(p.unit_price as double) as unit_price"""


@register("returns_enriched", "J10", sql(f"""select {_RETURN_COLS} from stock_returns sr {_MOVE_FROM.format(a='sr')}
where {_between('sr.date', FROM, TO)} and sr.reason = 'expired' and sr.condition = 'good'""",
                                         "stock_returns", "salespersons", "products"))
def _j10(t):
    return L.returns_enriched(t, from_=FROM, to_=TO, reason="expired", condition="good")


@register("salesperson_with_stock", "J11", sql("""select sp.id as salesperson_id, sp.code as salesperson_code,
  sp.name as salesperson_name, sp.vehicle_number, ss.product_id, ss.quantity as stock_quantity,
  p.name as product_name, p.code as product_code, cast(p.unit_price as double) as unit_price
from salespersons sp left join salesperson_stock ss on sp.id = ss.salesperson_id
left join products p on ss.product_id = p.id
where sp.is_active = 1""", "salespersons", "salesperson_stock", "products"))
def _j11(t):
    return L.salesperson_with_stock(t, t.salespersons.select("id"))


@register("field_stock", "J12", sql(f"""select ss.salesperson_id, ss.product_id, ss.quantity, p.name as product_name,
  p.code as product_code, cast(p.unit_price as double) as unit_price, p.unit,
  {_m("ss.quantity * p.unit_price", "value")}
from salesperson_stock ss left join products p on ss.product_id = p.id
where ss.salesperson_id in (select id from salespersons where is_active = 1) and p.is_active = 1 and ss.quantity > 0""",
                                     "salesperson_stock", "products", "salespersons"))
def _j12(t):
    return L.field_stock(t, t.salespersons.filter(F.col("is_active") == 1).select("id"))


@register("stock_available", "J13", sql(f"""select x.salesperson_id, x.product_id, coalesce(ss.quantity, 0) as quantity
from (select distinct s.salesperson_id, si.product_id from sale_items si join sales s on si.sale_id = s.id
      where {_between('s.date', FROM, TO)}) x
left join salesperson_stock ss on x.salesperson_id = ss.salesperson_id and x.product_id = ss.product_id""",
                                        "sale_items", "sales", "salesperson_stock"))
def _j13(t):
    pairs = t.sale_items.select("sale_id", "product_id").join(
        P.filter_dates(t.sales, "date", FROM, TO).select(F.col("id").alias("sale_id"), "salesperson_id"), "sale_id")
    return L.stock_available(t, pairs)


@register("shops_with_credit", "J14", sql("""select s.id, s.code, s.name, s.owner_name, s.is_active,
  cast(s.credit_limit as double) as credit_limit, cast(s.current_balance as double) as current_balance,
  d.name as district_name, tw.name as town_name, r.name as route_name,
  cast(s.current_balance - s.credit_limit as double) as available_credit,
  cast(s.credit_limit + least(s.current_balance, 0) as double) as headroom
from shops s left join districts d on s.district_id = d.id left join towns tw on s.town_id = tw.id
left join routes r on s.route_id = r.id where s.credit_limit > 0""", *_LOC))
def _j14(t):
    return L.shops_with_credit(t)


@register("sales_today_by_salesperson", "J15", sql(f"""select sp.id as salesperson_id, sp.code, sp.name,
  sp.vehicle_number,
  {_m("coalesce(sum(case when s.paid_amount is not null then s.paid_amount else 0 end), 0)", "total_sales")},
  count(s.id) as sale_count
from salespersons sp left join sales s on sp.id = s.salesperson_id and cast(s.date as date) = {_d(DAY)}
where sp.is_active = 1 group by sp.id, sp.code, sp.name, sp.vehicle_number""", "salespersons", "sales"))
def _j15(t):
    return L.sales_today_by_salesperson(t, DAY)


@register("list_products_by_price", "T2", sql("""select id, code, name, unit_price, stock_quantity from (
  select id, code, name, cast(unit_price as double) as unit_price, stock_quantity, unit_price as up from products
  where is_active = 1 order by up desc nulls last, id desc nulls last limit 50 offset 10) x""", "products"))
def _t2(t):
    return L.list_records(t, "products", {"is_active": 1}, "unit_price DESC", limit=50, offset=10).select(
        "id", "code", "name", F.col("unit_price").cast("double").alias("unit_price"), "stock_quantity")


@register("list_shops_clamped", "T2", sql("""select id, code, name, cast(current_balance as double) as current_balance
from (select * from shops where district_id = 3 order by current_balance asc nulls first, id asc nulls first
      limit 1000) x""", "shops"))
def _t2b(t):
    return L.list_records(t, "shops", {"district_id": 3}, "current_balance ASC", limit=5000, clamp=True).select(
        "id", "code", "name", F.col("current_balance").cast("double").alias("current_balance"))


@register("ordered_collections", "T1", sql(f"""select id, date, {_m("amount", "amount")} from (
  select * from collections) x""", "collections"))
def _t1(t):
    return L.ordered(t.collections, "collections", "amount", "DESC").select(
        "id", "date", F.col("amount").cast("double").alias("amount"))


@register("recent_sales", "T4", sql(f"""select {_SALE_COLS} {_SALE_FROM}
order by s.date desc nulls last, s.id desc nulls last limit 10""", *_SALE_T))
def _t4(t):
    return L.recent_sales(t, 10)


@register("products_by_name", "T5", sql("""select id, code, name, category, is_active from products
where is_active = 1""", "products"))
def _t5(t):
    return L.products_by_name(t).select("id", "code", "name", "category", "is_active")


@register("districts_by_name", "T5", sql("select id, code, name from districts", "districts"))
def _t5d(t):
    return L.districts_by_name(t).select("id", "code", "name")


@register("search_products", "F8", sql("""select id, code, name from products
where is_active = 1 and (code ilike '%gear%' or name ilike '%gear%')""", "products"))
def _f8(t):
    return P.search_products(t, "GEAR").select("id", "code", "name")


@register("towns_in_district", "F10", sql("""select id, code, name, district_id from towns
where district_id in (select id from districts)""", "towns", "districts"))
def _f10(t):
    return P.towns_in_district(t, t.districts.select("id")).select("id", "code", "name", "district_id")


@register("routes_in_town", "F11", sql("""select r.id, r.code, r.name, r.town_id, tw.name as town_name
from routes r left join towns tw on r.town_id = tw.id
where r.town_id in (select id from towns)""", "routes", "towns"))
def _f11(t):
    return P.routes_in_town(t, t.towns.select("id")).select("id", "code", "name", "town_id", "town_name")


@register("towns_of_selected_districts", "F10", sql("""select id, code, name, district_id from towns
where district_id in (select id from districts where name like 'A%')""", "towns", "districts"))
def _f10s(t):
    return P.towns_in_district(t, t.districts.filter(F.col("name").startswith("A")).select("id")).select(
        "id", "code", "name", "district_id")


@register("routes_of_selected_towns", "F11", sql("""select r.id, r.code, r.name, r.town_id, tw.name as town_name
from routes r left join towns tw on r.town_id = tw.id
where r.town_id in (select tw2.id from towns tw2 join districts d on tw2.district_id = d.id where d.name like 'A%')""",
                                                  "routes", "towns", "districts"))
def _f11s(t):
    chosen = P.towns_in_district(t, t.districts.filter(F.col("name").startswith("A")).select("id")).select("id")
    return P.routes_in_town(t, chosen).select("id", "code", "name", "town_id", "town_name")


@register("stock_of_high_targets", "J11", sql("""select sp.id as salesperson_id, sp.code as salesperson_code,
  sp.name as salesperson_name, sp.vehicle_number, ss.product_id, ss.quantity as stock_quantity,
  p.name as product_name, p.code as product_code, cast(p.unit_price as double) as unit_price
from salespersons sp left join salesperson_stock ss on sp.id = ss.salesperson_id
left join products p on ss.product_id = p.id
where sp.is_active = 1 and sp.target_amount > 1500000""", "salespersons", "salesperson_stock", "products"))
def _j11s(t):
    return L.salesperson_with_stock(t, t.salespersons.filter("target_amount > 1500000").select("id"))


@register("products_in_category", "F12", sql("""select id, code, name, category from products
where lower(coalesce(category, 'general')) in ('standard', 'general')""", "products"))
def _f12(t):
    return P.products_in_category(t, ["Standard", "GENERAL"]).select("id", "code", "name", "category")


@register("recent_activity", "U1", sql(f"""
select cast(null as bigint) as id, si.date, 'issue' as type, si.quantity_issued as quantity,
  {_m("si.quantity_issued * p.unit_price", "value")}, p.name as product_name, sp.name as salesperson_name,
  cast(null as varchar) as reason
from stock_issues si {_MOVE_FROM.format(a='si')} where cast(si.date as date) = {_d(DAY)}
union all
select cast(null as bigint), sr.date, 'return', sr.quantity_returned, {_m("sr.quantity_returned * p.unit_price", "v")},
  p.name, sp.name, sr.reason
from stock_returns sr {_MOVE_FROM.format(a='sr')} where cast(sr.date as date) = {_d(DAY)}
""", "stock_issues", "stock_returns", "salespersons", "products"))
def _u1(t):
    return U.recent_activity(t, DAY)


@register("search_all", "U2", sql("""
(select 'product' as type, id, code, name from products
 where (code ilike '%00001%' or name ilike '%00001%') and is_active = 1 order by code asc nulls last, id limit 5)
union all
(select 'salesperson', id, code, name from salespersons
 where (code ilike '%00001%' or name ilike '%00001%') and is_active = 1 order by code asc nulls last, id limit 5)
union all
(select 'shop', id, code, name from shops
 where code ilike '%00001%' or name ilike '%00001%' or owner_name ilike '%00001%' order by code asc nulls last, id limit 5)
""", "products", "salespersons", "shops"))
def _u2(t):
    return U.search_all(t, "00001", 5)


_MOVES = """
select 'issue' as source, cast(null as bigint) as source_id, date as ts, 'warehouse' as resource,
  product_id as k1, cast(-1 as bigint) as k2, cast(-quantity_issued as decimal(18,2)) as delta from stock_issues
union all select 'issue', null, date, 'field', salesperson_id, product_id, cast(quantity_issued as decimal(18,2))
  from stock_issues
union all select 'return', null, date, 'field', salesperson_id, product_id, cast(-quantity_returned as decimal(18,2))
  from stock_returns
union all select 'return', null, date, 'warehouse', product_id, -1, cast(quantity_returned as decimal(18,2))
  from stock_returns
union all select 'sale', si.sale_id, s.date, 'field', s.salesperson_id, si.product_id, cast(-si.quantity as decimal(18,2))
  from sale_items si join sales s on si.sale_id = s.id
union all select 'sale', id, date, 'debt', shop_id, -1, balance_amount from sales where balance_amount > 0
union all select 'collection', id, date, 'debt', shop_id, -1, -amount from collections
"""
MOVE_TABLES = ("stock_issues", "stock_returns", "sale_items", "sales", "collections")


@register("movements", "U3", sql(f"""select source, source_id, ts, resource, k1, k2, cast(delta as double) as delta
from ({_MOVES}) m""", *MOVE_TABLES))
def _u3(t):
    return U.movements(t).withColumn("delta", F.col("delta").cast("double"))
