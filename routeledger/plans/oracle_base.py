"""Adapter CTEs for the oracle SQL (DuckDB dialect, also valid Spark SQL).

Each oracle text is ``WITH <needed adapter CTEs> <query>``; the raw driver
tables are already views in DuckDB.  ``sql(body, *tables)`` assembles it.
"""

from __future__ import annotations

SEG = ("(case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2 "
       "when 'HOUSEHOLD' then 3 else 4 end)")

ADAPTER: dict[str, str] = {
    "districts": """select cast(r_regionkey as bigint) as id, concat('DT', lpad(cast(r_regionkey as varchar(20)),3,'0')) as code,
  r_name as name from region""",
    "towns": """select cast(n_nationkey as bigint) as id, concat('TW', lpad(cast(n_nationkey as varchar(20)),3,'0')) as code,
  n_name as name, cast(n_regionkey as bigint) as district_id from nation""",
    "routes": f"""select distinct cast(c_nationkey*10+{SEG} as bigint) as id,
  concat('RT', lpad(cast(c_nationkey*10+{SEG} as varchar(20)),4,'0')) as code,
  concat(c_mktsegment,' ',cast(c_nationkey as varchar(20))) as name, cast(c_nationkey as bigint) as town_id from customer""",
    "products": """select p_partkey as id, concat('PRD', lpad(cast(p_partkey as varchar(20)),7,'0')) as code, p_name as name,
  cast(p_retailprice as decimal(18,2)) as unit_price, cast((p_partkey*37)%121 as bigint) as stock_quantity,
  cast(p_size as bigint) as min_stock_level,
  case when p_partkey%11=0 then null else lower(p_type) end as category, p_brand as brand, 'units' as unit,
  case when p_partkey%20=19 then 0 else 1 end as is_active from part""",
    "product_categories": """select row_number() over (order by p_type) as id, upper(p_type) as code, lower(p_type) as value,
  p_type as name from (select distinct p_type from part) t""",
    "salespersons": """select s_suppkey as id, concat('SP', lpad(cast(s_suppkey as varchar(20)),6,'0')) as code, s_name as name,
  concat('V-', cast(s_suppkey%97 as varchar(20))) as vehicle_number,
  cast(1000000 + s_suppkey%10*100000 as decimal(18,2)) as target_amount,
  cast(s_suppkey%8 as double) as commission_rate, case when s_suppkey%10=9 then 0 else 1 end as is_active from supplier""",
    "shops": f"""select c_custkey as id, concat('SH', lpad(cast(c_custkey as varchar(20)),7,'0')) as code, c_name as name,
  concat('Owner ', cast(c_custkey%53 as varchar(20))) as owner_name, cast(n_regionkey as bigint) as district_id,
  cast(c_nationkey as bigint) as town_id, cast(c_nationkey*10+{SEG} as bigint) as route_id,
  cast(c_custkey%5*2500 as decimal(18,2)) as credit_limit,
  cast(cast(c_acctbal as decimal(18,2))-5000 as decimal(18,2)) as current_balance,
  case when c_custkey%25=24 then 0 else 1 end as is_active
  from customer join nation on c_nationkey=n_nationkey""",
    "sales": f"""select o_orderkey as id, o_orderdate as date, o_custkey as shop_id,
  o_orderkey%(select count(*) from supplier) as salesperson_id,
  cast(c_nationkey*10+{SEG} as bigint) as route_id, cast(o_totalprice as decimal(18,2)) as total_amount,
  case when o_orderstatus='F' then cast(o_totalprice as decimal(18,2)) else cast(floor(o_totalprice/2) as decimal(18,2)) end as paid_amount,
  case when o_orderstatus='F' then cast(0 as decimal(18,2))
       else cast(cast(o_totalprice as decimal(18,2))-cast(floor(o_totalprice/2) as decimal(18,2)) as decimal(18,2)) end as balance_amount,
  case when o_orderstatus='F' then 'cash' else 'credit' end as payment_type,
  case substr(o_orderpriority,1,1) when '1' then 'card' when '2' then 'transfer' when '3' then 'cheque' else 'cash' end as payment_method
  from orders join customer on o_custkey=c_custkey""",
    "sale_items": """select l_orderkey as sale_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity,
  cast(l_extendedprice as decimal(18,2)) as total_price from lineitem""",
    "collections": """select event_id as id, ts as date, user_id as shop_id,
  event_id%(select count(*) from supplier) as salesperson_id,
  cast(value as decimal(18,2)) as amount, case when event_id%3=0 then 'cash' else 'card' end as payment_method
  from events where event_type='purchase'""",
    "stock_issues": """select l_suppkey as salesperson_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity_issued,
  l_shipdate as date, concat('V-', cast(l_suppkey%97 as varchar(20))) as vehicle_number
  from lineitem where l_returnflag<>'R'""",
    "stock_returns": """select l_suppkey as salesperson_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity_returned,
  l_shipdate as date,
  case l_linenumber%4 when 0 then 'damaged' when 1 then 'defective' when 2 then 'expired' else 'unsold' end as reason,
  case when l_linestatus='F' then 'good' else 'damaged' end as condition,
  case when l_linenumber%4<2 then 1 else 0 end as inspection_required,
  concat('note ', l_linestatus) as notes from lineitem where l_returnflag='R'""",
    "salesperson_stock": """select l_suppkey as salesperson_id, l_partkey as product_id,
  sum(cast(l_quantity as bigint))%60 as quantity
  from lineitem where l_returnflag='N' group by l_suppkey, l_partkey""",
}


def sql(body: str, *tables: str) -> str:
    """``WITH`` the adapter CTEs for ``tables`` in front of ``body``."""
    ctes = ",\n".join(f"{name} as (\n{ADAPTER[name]}\n)" for name in tables)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
