"""Registered report queries (A1..A31) with their oracle SQL."""

from __future__ import annotations

import datetime as dt

from ..operators import reports as R
from .catalog import AS_OF, CDAY, CFROM, CTO, DAY, FROM, TO, _between, _d, _m, register
from .oracle_base import sql

_AS_OF_MINUS_30 = (dt.date.fromisoformat(AS_OF) - dt.timedelta(days=30)).isoformat()


@register("salesperson_stock_summary", "A1", sql(f"""
select sp.id, sp.code, sp.name, sp.vehicle_number, sp.is_active,
  count(distinct ss.product_id) as product_count,
  cast(coalesce(sum(ss.quantity), 0) as bigint) as total_stock_quantity,
  {_m("coalesce(sum(ss.quantity * p.unit_price), 0)", "stock_value")}
from salespersons sp
left join salesperson_stock ss on sp.id = ss.salesperson_id
left join products p on ss.product_id = p.id
where sp.is_active = 1
group by sp.id, sp.code, sp.name, sp.vehicle_number, sp.is_active
""", "salespersons", "salesperson_stock", "products"))
def _a1(t):
    return R.salesperson_stock_summary(t)


@register("daily_sales_by_salesperson", "A2", sql(f"""
select s.salesperson_id, {_d(DAY)} as sale_date, sp.name as salesperson_name,
  count(distinct s.id) as total_sales, {_m("sum(s.total_amount)", "total_amount")},
  {_m("sum(s.paid_amount)", "total_paid")}, {_m("sum(s.balance_amount)", "total_balance")}
from sales s left join salespersons sp on s.salesperson_id = sp.id
where cast(s.date as date) = {_d(DAY)}
group by s.salesperson_id, sp.name
""", "salespersons", "sales"))
def _a2(t):
    return R.daily_sales_by_salesperson(t, DAY)


@register("sales_by_product", "A3", sql(f"""
select si.product_id, p.code, p.name, cast(sum(si.quantity) as bigint) as total_quantity,
  {_m("sum(si.total_price)", "total_amount")}, count(distinct s.id) as sale_count
from sale_items si
left join products p on si.product_id = p.id
left join sales s on si.sale_id = s.id
where {_between("s.date", FROM, TO)}
group by si.product_id, p.code, p.name
""", "products", "sales", "sale_items"))
def _a3(t):
    return R.sales_by_product(t, FROM, TO)


@register("daily_collections_by_salesperson", "A4", sql(f"""
select c.salesperson_id, {_d(CDAY)} as collection_date, sp.name as salesperson_name,
  count(distinct c.id) as total_collections, {_m("sum(c.amount)", "total_amount")}
from collections c left join salespersons sp on c.salesperson_id = sp.id
where cast(c.date as date) = {_d(CDAY)}
group by c.salesperson_id, sp.name
""", "salespersons", "collections"))
def _a4(t):
    return R.daily_collections_by_salesperson(t, CDAY)


@register("daily_sales_summary", "A5", sql(f"""
select cast(date as date) as sale_date, count(*) as total_sales, {_m("sum(total_amount)", "total_amount")},
  {_m("sum(paid_amount)", "total_paid")}, {_m("sum(balance_amount)", "total_balance")}
from sales where {_between("date", FROM, TO)}
group by cast(date as date)
""", "sales"))
def _a5(t):
    return R.daily_sales_summary(t, FROM, TO)


_PERF_CORRECT = f"""
select sp.id as salesperson_id, sp.name as salesperson_name, coalesce(s.total_sales, 0) as total_sales,
  {_m("s.total_amount", "total_amount")}, {_m("s.total_paid", "total_paid")}, {_m("s.total_balance", "total_balance")},
  coalesce(c.total_collections, 0) as total_collections, {_m("c.collection_amount", "collection_amount")}
from salespersons sp
left join (select salesperson_id, count(distinct id) as total_sales, sum(total_amount) as total_amount,
                  sum(paid_amount) as total_paid, sum(balance_amount) as total_balance
           from sales where {_between("date", FROM, TO)} group by salesperson_id) s on sp.id = s.salesperson_id
left join (select salesperson_id, count(distinct id) as total_collections, sum(amount) as collection_amount
           from collections where {_between("date", CFROM, CTO)} group by salesperson_id) c
  on sp.id = c.salesperson_id
where sp.is_active = 1
"""

# The reference's own shape: both facts LEFT JOINed before grouping (fan-out).
_PERF_COMPAT = f"""
select sp.id as salesperson_id, sp.name as salesperson_name, count(distinct s.id) as total_sales,
  {_m("sum(s.total_amount)", "total_amount")}, {_m("sum(s.paid_amount)", "total_paid")},
  {_m("sum(s.balance_amount)", "total_balance")},
  count(distinct c.id) as total_collections, {_m("sum(c.amount)", "collection_amount")}
from salespersons sp
left join sales s on sp.id = s.salesperson_id and {_between("s.date", FROM, TO)}
left join collections c on sp.id = c.salesperson_id and {_between("c.date", CFROM, CTO)}
where sp.is_active = 1
group by sp.id, sp.name
"""


@register("salesperson_performance", "A6", sql(_PERF_CORRECT, "salespersons", "sales", "collections"))
def _a6(t):
    return R.salesperson_performance(t, FROM, TO, CFROM, CTO)


@register("salesperson_performance_compat", "A6", sql(_PERF_COMPAT, "salespersons", "sales", "collections"))
def _a6c(t):
    return R.salesperson_performance(t, FROM, TO, CFROM, CTO, compat=True)


_RISK = """case when s.credit_limit = 0 then 'No Credit' when s.current_balance >= 0 then 'No Outstanding'
  when abs(s.current_balance) > s.credit_limit * 0.8 then 'High Risk'
  when abs(s.current_balance) > s.credit_limit * 0.5 then 'Medium Risk' else 'Low Risk' end"""


@register("shop_outstanding", "A7", sql(f"""
with debtors as (select *, -current_balance as debt from shops where current_balance < 0),
places as (select r.id as route_id, r.name as route_name from routes r),
banded as (select d.*, {_RISK.replace("s.", "d.")} as risk_level from debtors d)
select id as shop_id, name as shop_name, owner_name, cast(null as varchar) as contact_number,
  {_m("-debt", "current_balance")}, {_m("credit_limit", "credit_limit")}, route_name,
  (select max(towns.name) from towns where towns.id = banded.town_id) as town_name,
  (select max(districts.name) from districts where districts.id = banded.district_id) as district_name, risk_level
from banded left join places using (route_id)
""", "shops", "routes", "towns", "districts"))
def _a7(t):
    return R.shop_outstanding(t)


_STATUS = """case when p.stock_quantity <= p.min_stock_level then 'Low Stock'
  when p.stock_quantity <= p.min_stock_level * 2 then 'Medium Stock' else 'Good Stock' end"""


@register("stock_level_report", "A8", sql(f"""
select p.id, p.code, p.name, p.stock_quantity, p.min_stock_level, p.unit, {_m("p.unit_price", "unit_price")},
  {_STATUS} as stock_status, cast(coalesce(x.q, 0) as bigint) as total_sold_last_month
from products p
left join (select si.product_id, sum(si.quantity) as q from sale_items si join sales s on si.sale_id = s.id
           where {_between("s.date", _AS_OF_MINUS_30, AS_OF)} group by si.product_id) x on p.id = x.product_id
where p.is_active = 1
""", "products", "sales", "sale_items"))
def _a8(t):
    return R.stock_level_report(t, AS_OF)


@register("stock_level_report_compat", "A8", sql(f"""
select p.id, p.code, p.name, p.stock_quantity, p.min_stock_level, p.unit, {_m("p.unit_price", "unit_price")},
  {_STATUS} as stock_status, cast(sum(coalesce(si.quantity, 0)) as bigint) as total_sold_last_month
from products p
left join sale_items si on p.id = si.product_id
left join sales s on si.sale_id = s.id and cast(s.date as date) >= {_d(_AS_OF_MINUS_30)}
where p.is_active = 1
group by p.id, p.code, p.name, p.stock_quantity, p.min_stock_level, p.unit, p.unit_price
""", "products", "sales", "sale_items"))
def _a8c(t):
    return R.stock_level_report(t, AS_OF, compat=True)


_URG = """case when p.stock_quantity = 0 then 'critical' when p.stock_quantity <= p.min_stock_level * 0.25 then 'critical'
  when p.stock_quantity <= p.min_stock_level * 0.5 then 'high' when p.stock_quantity <= p.min_stock_level * 0.75 then 'medium'
  else 'low' end"""
_URG_RANK = """case when p.stock_quantity = 0 then 0 when p.stock_quantity <= p.min_stock_level * 0.25 then 1
  when p.stock_quantity <= p.min_stock_level * 0.5 then 2 when p.stock_quantity <= p.min_stock_level * 0.75 then 3
  else 4 end"""


@register("low_stock_alerts", "A9", sql(f"""
with short as (select *, greatest(min_stock_level - stock_quantity, 0) as missing from products where is_active = 1
               and min_stock_level >= stock_quantity)
select p.id, p.code, p.name, p.category, p.stock_quantity, p.min_stock_level, {_m("p.unit_price", "unit_price")},
  p.missing as deficit, {_m("(p.min_stock_level - p.missing) * p.unit_price", "current_value")},
  {_m("(p.stock_quantity + p.missing) * p.unit_price", "target_value")}, {_URG} as urgency, {_URG_RANK} as urgency_rank
from short p
""", "products"))
def _a9(t):
    return R.low_stock_alerts(t)


@register("field_stock_distribution", "A10", sql(f"""
with held as (
  select ss.salesperson_id, count(distinct ss.product_id) as product_count, sum(ss.quantity) as total_quantity,
    sum(ss.quantity * p.unit_price) as total_value, avg(cast(p.unit_price as double)) as mean_price,
    cast(sum(p.unit_price) as double) as price_sum, count(p.unit_price) as priced
  from salesperson_stock ss left join products p on p.id = ss.product_id group by ss.salesperson_id)
select sp.id as salesperson_id, sp.name as salesperson_name, sp.code as salesperson_code, sp.vehicle_number,
  held.product_count, cast(held.total_quantity as bigint) as total_quantity, {_m("coalesce(held.total_value, 0)", "total_value")},
  case when held.priced > 0 then held.price_sum / held.priced else 0.0 end as avg_product_price
from held join salespersons sp on sp.id = held.salesperson_id and sp.is_active = 1
where held.total_quantity > 0
""", "salespersons", "salesperson_stock", "products"))
def _a10(t):
    return R.field_stock_distribution(t)


@register("field_stock_value", "A11", sql(f"""
select {_m("coalesce(sum(ss.quantity * p.unit_price), 0)", "total")}
from salesperson_stock ss left join products p on ss.product_id = p.id
where ss.quantity > 0 and p.is_active = 1
""", "salesperson_stock", "products"))
def _a11(t):
    return R.field_stock_value(t)


@register("return_statistics", "A12", sql(f"""
select count(*) as total_returned,
  count(case when cast(sr.date as date) = {_d(DAY)} then 1 end) as today_returned,
  count(case when sr.reason in ('damaged', 'defective') then 1 end) as damaged_returns,
  count(case when sr.inspection_required = 1 then 1 end) as pending_inspection,
  {_m("coalesce(sum(sr.quantity_returned * p.unit_price), 0)", "total_value")}
from stock_returns sr left join products p on sr.product_id = p.id
""", "stock_returns", "products"))
def _a12(t):
    return R.return_statistics(t, DAY)


@register("issue_statistics", "A13", sql(f"""
select count(*) as total_issued,
  count(case when cast(si.date as date) = {_d(DAY)} then 1 end) as today_issued,
  count(distinct si.product_id) as unique_products, count(distinct si.salesperson_id) as unique_salespersons,
  {_m("coalesce(sum(si.quantity_issued * p.unit_price), 0)", "total_value")}
from stock_issues si left join products p on si.product_id = p.id
""", "stock_issues", "products"))
def _a13(t):
    return R.issue_statistics(t, DAY)


ISSUE_SEARCH_TERM = "Gear"
RETURN_SEARCH_TERM = "00000001"


def _movement_from(table: str, alias: str) -> str:
    return (f"from {table} {alias} left join salespersons sp on {alias}.salesperson_id = sp.id "
            f"left join products p on {alias}.product_id = p.id")


def _search(alias: str, last: str, term: str) -> str:
    pat = f"'%{term}%'"
    return (f"(p.name ilike {pat} or p.code ilike {pat} or sp.name ilike {pat} or sp.code ilike {pat} "
            f"or {alias}.{last} ilike {pat})")


@register("count_issues", "A14", sql(f"""
select count(*) as count {_movement_from("stock_issues", "si")}
where {_between("si.date", FROM, TO)} and {_search("si", "vehicle_number", ISSUE_SEARCH_TERM)}
""", "stock_issues", "salespersons", "products"))
def _a14(t):
    return R.count_issues(t, from_=FROM, to_=TO, search=ISSUE_SEARCH_TERM)


@register("count_returns", "A15", sql(f"""
select count(*) as count {_movement_from("stock_returns", "sr")}
where {_between("sr.date", FROM, TO)} and sr.reason = 'damaged'
  and {_search("sr", "notes", RETURN_SEARCH_TERM)}
""", "stock_returns", "salespersons", "products"))
def _a15(t):
    return R.count_returns(t, from_=FROM, to_=TO, reason="damaged", search=RETURN_SEARCH_TERM)


@register("dashboard_stats", "A16", sql(f"""
with facts as (
  select 'product' as what, 1 as n, 0 as x from products where is_active = 1
  union all select 'salesperson', 1, 0 from salespersons where is_active = 1
  union all select 'shop', 1, least(current_balance, 0) from shops
  union all select 'sale', 1, total_amount from sales where cast(date as date) = {_d(DAY)}
  union all select 'collection', 1, amount from collections where cast(date as date) = {_d(DAY)})
select count(*) filter (what = 'product') as total_products, count(*) filter (what = 'salesperson') as total_salespersons,
  count(*) filter (what = 'shop') as total_shops, count(*) filter (what = 'sale') as today_sales,
  cast(coalesce(sum(x) filter (what = 'sale'), 0) as double) as today_sales_amount,
  cast(coalesce(sum(x) filter (what = 'collection'), 0) as double) as today_collections,
  cast(coalesce(sum(x) filter (what = 'shop'), 0) as double) as total_outstanding
from facts
""", "products", "salespersons", "shops", "sales", "collections"))
def _a16(t):
    return R.dashboard_stats(t, DAY)


@register("category_product_counts", "A17", sql("""
with n as (select lower(coalesce(category, 'general')) as k, count(*) as c from products group by 1)
select pc.id, pc.code, pc.value, pc.name, coalesce(n.c, 0) as product_count
from product_categories pc left join n on n.k = lower(pc.value)
""", "product_categories", "products"))
def _a17(t):
    return R.category_product_counts(t)


@register("entity_usage_product", "A18", sql("""
select p.id,
  (select count(*) from sale_items x where x.product_id = p.id) as sale_item_count,
  (select count(*) from stock_issues x where x.product_id = p.id) as issue_count,
  (select count(*) from stock_returns x where x.product_id = p.id) as return_count,
  ((select count(*) from sale_items x where x.product_id = p.id) > 0
   or (select count(*) from stock_issues x where x.product_id = p.id) > 0
   or (select count(*) from stock_returns x where x.product_id = p.id) > 0) as in_use
from products p
""", "products", "sale_items", "stock_issues", "stock_returns"))
def _a18p(t):
    return R.entity_usage(t, "product")


@register("entity_usage_salesperson", "A18", sql("""
select sp.id,
  (select count(*) from salesperson_stock x where x.salesperson_id = sp.id and x.quantity > 0) as stock_count,
  (select count(*) from sales x where x.salesperson_id = sp.id) as sale_count,
  (select count(*) from collections x where x.salesperson_id = sp.id) as collection_count,
  ((select count(*) from salesperson_stock x where x.salesperson_id = sp.id and x.quantity > 0) > 0
   or (select count(*) from sales x where x.salesperson_id = sp.id) > 0
   or (select count(*) from collections x where x.salesperson_id = sp.id) > 0) as in_use
from salespersons sp
""", "salespersons", "salesperson_stock", "sales", "collections"))
def _a18s(t):
    return R.entity_usage(t, "salesperson")


@register("entity_usage_town", "A18", sql("""
select tw.id,
  (select count(*) from routes x where x.town_id = tw.id) as route_count,
  (select count(*) from shops x where x.town_id = tw.id) as shop_count,
  ((select count(*) from routes x where x.town_id = tw.id) > 0
   or (select count(*) from shops x where x.town_id = tw.id) > 0) as in_use
from towns tw
""", "towns", "routes", "shops"))
def _a18t(t):
    return R.entity_usage(t, "town")


@register("kpi_cards", "A19", sql(f"""
select {_m("s.revenue", "revenue")}, {_m("c.collections", "collections")}, {_m("sh.outstanding", "outstanding")},
  case when p.active_products = 0 then null
       else cast(100 as double) * cast(p.healthy as double) / cast(p.active_products as double) end as inventory_health,
  s.transactions,
  case when s.transactions = 0 then null else cast(s.revenue as double) / cast(s.transactions as double) end
    as avg_order_value,
  sh.active_shops, p.active_products
from (select coalesce(sum(total_amount), 0) as revenue, count(*) as transactions from sales
      where {_between("date", FROM, TO)}) s,
     (select coalesce(sum(amount), 0) as collections from collections where {_between("date", CFROM, CTO)}) c,
     (select coalesce(sum(case when current_balance < 0 then current_balance end), 0) as outstanding,
             count(case when is_active = 1 then 1 end) as active_shops from shops) sh,
     (select count(*) as active_products, count(case when stock_quantity > min_stock_level then 1 end) as healthy
      from products where is_active = 1) p
""", "sales", "collections", "shops", "products"))
def _a19(t):
    return R.kpi_cards(t, FROM, TO, CFROM, CTO)


def _trend_sql(grain: str) -> str:
    return sql(f"""
select cal.bucket, {_m("coalesce(a.revenue, 0)", "revenue")}, coalesce(a.sale_count, 0) as sale_count
from (select distinct cast(date_trunc('{grain}', d) as date) as bucket
      from (select cast(unnest(generate_series(timestamp '{FROM}', timestamp '{TO}', interval 1 day)) as date) as d) g
     ) cal
left join (select cast(date_trunc('{grain}', cast(date as date)) as date) as bucket, sum(total_amount) as revenue,
                  count(*) as sale_count
           from sales where {_between("date", FROM, TO)} group by 1) a on cal.bucket = a.bucket
""", "sales")


@register("sales_trend_day", "A20", _trend_sql("day"))
def _a20d(t):
    return R.sales_trend(t, FROM, TO, "day")


@register("sales_trend_week", "A20", _trend_sql("week"))
def _a20w(t):
    return R.sales_trend(t, FROM, TO, "week")


@register("sales_trend_month", "A20", _trend_sql("month"))
def _a20m(t):
    return R.sales_trend(t, FROM, TO, "month")


@register("payment_distribution", "A21", sql(f"""
select payment_method, payment_type, sale_count, {_m("amount", "amount")},
  case when sum(amount) over () <> 0 then cast(amount as double) / cast(sum(amount) over () as double) end as share
from (select coalesce(payment_method, 'unknown') as payment_method, coalesce(payment_type, 'unknown') as payment_type,
             count(*) as sale_count, sum(total_amount) as amount
      from sales where {_between("date", FROM, TO)} group by 1, 2) g
""", "sales"))
def _a21(t):
    return R.payment_distribution(t, FROM, TO)


@register("top_products", "A22", sql(f"""
select si.product_id, p.code, p.name, cast(sum(si.quantity) as bigint) as total_quantity,
  {_m("sum(si.total_price)", "total_amount")}, count(distinct s.id) as sale_count
from sale_items si join sales s on si.sale_id = s.id left join products p on si.product_id = p.id
where {_between("s.date", FROM, TO)}
group by si.product_id, p.code, p.name
order by sum(si.total_price) desc nulls last, p.code asc nulls last, si.product_id asc
limit 10
""", "products", "sales", "sale_items"))
def _a22(t):
    return R.top_products(t, FROM, TO, 10)


_ACTUAL = f"""(select sp.id as salesperson_id, sp.name as salesperson_name, sp.target_amount, sp.commission_rate,
  coalesce(a.actual, 0) as actual
  from salespersons sp left join (select salesperson_id, sum(total_amount) as actual from sales
                                  where {_between("date", FROM, TO)} group by salesperson_id) a
  on sp.id = a.salesperson_id where sp.is_active = 1) x"""


@register("target_vs_actual", "A23", sql(f"""
select salesperson_id, salesperson_name, {_m("target_amount", "target_amount")}, {_m("actual", "actual")},
  case when target_amount <> 0
       then cast(actual as double) * cast(100 as double) / cast(target_amount as double) end as achievement_pct
from {_ACTUAL}
""", "salespersons", "sales"))
def _a23(t):
    return R.target_vs_actual(t, FROM, TO)


@register("inventory_value", "A24", sql("""
select category, code, cast(sum(stock_quantity) as bigint) as units, cast(sum(v) as double) as value,
  grouping(category, code) as level
from (select lower(coalesce(category, 'general')) as category, code, stock_quantity, stock_quantity * unit_price as v
      from products where is_active = 1) p
group by rollup(category, code)
""", "products"))
def _a24(t):
    return R.inventory_value(t)


_SALES_ENRICHED = f"""(select s.id, s.date, sh.name as shop_name, sp.name as salesperson_name, r.name as route_name,
  s.payment_type, s.total_amount, s.paid_amount, s.balance_amount
  from sales s left join shops sh on s.shop_id = sh.id left join salespersons sp on s.salesperson_id = sp.id
  left join routes r on s.route_id = r.id where {_between("s.date", FROM, TO)})"""


@register("sales_report", "A25", sql(f"""
select id, date, shop_name, salesperson_name, route_name, payment_type, {_m("total_amount", "total_amount")},
  {_m("paid_amount", "paid_amount")}, {_m("balance_amount", "balance_amount")}, cast(1 as bigint) as row_count,
  0 as is_total
from {_SALES_ENRICHED} d
union all
select null, null, null, null, null, null, {_m("sum(total_amount)", "total_amount")},
  {_m("sum(paid_amount)", "paid_amount")}, {_m("sum(balance_amount)", "balance_amount")}, count(*), 1
from {_SALES_ENRICHED} d2
""", "sales", "shops", "salespersons", "routes"))
def _a25(t):
    return R.sales_report(t, from_=FROM, to_=TO)


_COLL_ENRICHED = f"""(select c.id, c.date, sh.name as shop_name, sp.name as salesperson_name, c.payment_method, c.amount
  from collections c left join shops sh on c.shop_id = sh.id left join salespersons sp on c.salesperson_id = sp.id
  where {_between("c.date", CFROM, CTO)})"""


@register("collections_report", "A26", sql(f"""
select id, date, shop_name, salesperson_name, payment_method, {_m("amount", "amount")},
  cast(1 as bigint) as row_count, 0 as is_total
from {_COLL_ENRICHED} d
union all
select null, null, null, null, null, {_m("sum(amount)", "amount")}, count(*), 1 from {_COLL_ENRICHED} d2
""", "collections", "shops", "salespersons"))
def _a26(t):
    return R.collections_report(t, from_=CFROM, to_=CTO)


_ISSUES = f"""(select si.date, si.salesperson_id, sp.name as salesperson_name, si.product_id, p.code as product_code,
  p.name as product_name, si.quantity_issued as units, si.quantity_issued * p.unit_price as value
  {_movement_from("stock_issues", "si")} where {_between("si.date", FROM, TO)})"""


@register("issues_report", "A27", sql(f"""
select date, salesperson_id, salesperson_name, product_id, product_code, product_name, units,
  {_m("value", "value")}, cast(1 as bigint) as row_count, 0 as is_total
from {_ISSUES} d
union all
select null, null, null, null, null, null, cast(sum(units) as bigint), {_m("sum(value)", "value")}, count(*), 1
from {_ISSUES} d2
""", "stock_issues", "salespersons", "products"))
def _a27(t):
    return R.issues_report(t, from_=FROM, to_=TO)


@register("returns_report", "A28", sql(f"""
select sr.reason, sr.condition, count(*) as return_count, cast(sum(sr.quantity_returned) as bigint) as units,
  {_m("sum(sr.quantity_returned * p.unit_price)", "value")}, grouping(sr.reason, sr.condition) as level
{_movement_from("stock_returns", "sr")}
where {_between("sr.date", FROM, TO)}
group by rollup(sr.reason, sr.condition)
""", "stock_returns", "salespersons", "products"))
def _a28(t):
    return R.returns_report(t, from_=FROM, to_=TO)


@register("sales_by_location", "A29", sql(f"""
select g.level, g.district_id, d.name as district_name, g.town_id, tw.name as town_name, g.route_id,
  r.name as route_name, {_m("g.revenue", "revenue")}, g.sale_count
from (select grouping(sh.district_id, sh.town_id, sh.route_id) as level, sh.district_id, sh.town_id, sh.route_id,
             sum(s.total_amount) as revenue, count(*) as sale_count
      from sales s left join shops sh on s.shop_id = sh.id
      where {_between("s.date", FROM, TO)}
      group by rollup(sh.district_id, sh.town_id, sh.route_id)) g
left join districts d on g.district_id = d.id
left join towns tw on g.town_id = tw.id
left join routes r on g.route_id = r.id
""", "sales", "shops", "districts", "towns", "routes"))
def _a29(t):
    return R.sales_by_location(t, FROM, TO)


@register("stock_overview", "A30", sql(f"""
select p.id, p.code, p.name, p.is_active, p.stock_quantity as warehouse_units,
  cast(coalesce(f.q, 0) as bigint) as field_units, p.stock_quantity + cast(coalesce(f.q, 0) as bigint) as total_units,
  {_m("(p.stock_quantity + coalesce(f.q, 0)) * p.unit_price", "value")}
from products p left join (select product_id, sum(quantity) as q from salesperson_stock group by product_id) f
  on p.id = f.product_id
""", "products", "salesperson_stock"))
def _a30(t):
    return R.stock_overview(t)


@register("commission", "A31", sql(f"""
select salesperson_id, salesperson_name, commission_rate, {_m("actual", "actual")},
  cast(actual as double) * commission_rate / cast(100 as double) as commission
from {_ACTUAL}
""", "salespersons", "sales"))
def _a31(t):
    return R.commission(t, FROM, TO)
