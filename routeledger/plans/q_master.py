"""Registered master-data queries (A18, L6, L8, L9, L10) of the entities that q_ledger and q_reports leave out.

The driver tables use almost every record somewhere, so the delete rules run
twice: on the whole tables, and on a bundle with few shops (those of a high
balance) and what refers to them, where some records are in use and some not.
Stock of any quantity above zero counts as held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as G
from ..operators import reports as R
from ..operators.activity import movements
from .catalog import register
from .oracle_base import sql
from .q_listings import _MOVES, MOVE_TABLES

_RICH = 4900
_FEW_T = ("districts", "towns", "routes", "salespersons", "shops", "sales", "collections", "salesperson_stock")


def _few(t):
    shops = t.shops.filter(F.col("current_balance") > _RICH)
    of = lambda df, fk, base: df.join(base.select(F.col("id").alias(fk)), fk, "left_semi").select(*df.columns)
    routes = t.routes.join(shops.select(F.col("town_id")), "town_id", "left_semi").select(*t.routes.columns)
    towns = t.towns.join(t.districts.filter(F.col("name").startswith("A")).select(F.col("id").alias("district_id")),
                         "district_id", "left_semi").select(*t.towns.columns)
    return t.with_tables(shops=shops, routes=routes, towns=towns, sales=of(t.sales, "shop_id", shops),
                         collections=of(t.collections, "shop_id", shops),
                         salesperson_stock=t.salesperson_stock.filter("quantity >= 59"))


_FEW = f"""few_shops as (select * from shops where current_balance > {_RICH}),
few_routes as (select * from routes where town_id in (select town_id from few_shops)),
few_towns as (select * from towns where district_id in (select id from districts where name like 'A%')),
few_sales as (select * from sales where shop_id in (select id from few_shops)),
few_collections as (select * from collections where shop_id in (select id from few_shops)),
few_stock as (select * from salesperson_stock where quantity >= 59)"""

# What counts as a use of a record, and the words a refusal names it with.
_USES = {
    "shop": ("few_shops", [("few_sales", "shop_id", "sale_count", "has sales"),
                           ("few_collections", "shop_id", "collection_count", "has collections")]),
    "salesperson": ("salespersons", [("few_stock", "salesperson_id", "stock_count", "holds stock"),
                                     ("few_sales", "salesperson_id", "sale_count", "has sales"),
                                     ("few_collections", "salesperson_id", "collection_count", "has collections")]),
    "district": ("districts", [("few_towns", "district_id", "town_count", "has towns")]),
    "town": ("few_towns", [("few_routes", "town_id", "route_count", "has routes"),
                           ("few_shops", "town_id", "shop_count", "has shops")]),
    "route": ("few_routes", [("few_shops", "route_id", "shop_count", "has shops"),
                             ("few_sales", "route_id", "sale_count", "has sales")]),
}


def _use_sql(entity: str) -> str:
    base, uses = _USES[entity]
    joins = " ".join(f"left join (select {fk} as k, count(*) as n from {table} group by {fk}) u{i} on u{i}.k = b.id"
                     for i, (table, fk, _, _) in enumerate(uses))
    counts = ", ".join(f"coalesce(u{i}.n, 0) as {name}" for i, (_, _, name, _) in enumerate(uses))
    return f"(select b.id, {counts} from {base} b {joins})"


def _usage_oracle(entity: str) -> str:
    names = [name for _, _, name, _ in _USES[entity][1]]
    return sql(f"with {_FEW} select id, {', '.join(names)}, {' + '.join(names)} > 0 as in_use from {_use_sql(entity)} x", *_FEW_T)


def _outcome_oracle(entity: str) -> str:
    uses = _USES[entity][1]
    total = " + ".join(name for _, _, name, _ in uses)
    words = ", ".join(f"case when {name} > 0 then '{said}' end" for _, _, name, said in uses)
    return sql(f"""with {_FEW} select id, case when {total} > 0 then 'refused' else 'deleted' end as action,
  case when {total} > 0 then concat_ws(', ', {words}) end as reason from {_use_sql(entity)} x""", *_FEW_T)


def _after_oracle(entity: str) -> str:
    total = " + ".join(name for _, _, name, _ in _USES[entity][1])
    base = _USES[entity][0]
    return sql(f"with {_FEW} select b.id, b.code, b.name from {base} b join {_use_sql(entity)} x on b.id = x.id where {total} > 0", *_FEW_T)


def _register_uses(entity: str) -> None:
    table = R._ENTITY_TABLE[entity]

    @register(f"entity_usage_few_{table}", "A18", _usage_oracle(entity))
    def _usage(t):
        return R.entity_usage(_few(t), entity)

    @register(f"delete_few_{table}_outcome", "L9", _outcome_oracle(entity))
    def _outcome(t):
        few = _few(t)
        return G.delete_outcome(few, entity, few.get(table).select("id"))

    @register(f"delete_few_{table}_after", "L9", _after_oracle(entity))
    def _after(t):
        few = _few(t)
        after, _ = G.delete_records(few, entity, few.get(table).select("id"))
        return after.get(table).select("id", "code", "name")


def _whole(oracle: str) -> str:
    """The same SQL on the whole tables."""
    return oracle.replace(_FEW, "held as (select * from salesperson_stock where quantity > 0)").replace("few_stock", "held").replace("few_", "")


def _register_whole(entity: str) -> None:
    table = R._ENTITY_TABLE[entity]

    @register(f"entity_usage_all_{table}", "A18", _whole(_usage_oracle(entity)))
    def _usage(t):
        return R.entity_usage(t, entity)

    @register(f"delete_all_{table}_outcome", "L9", _whole(_outcome_oracle(entity)))
    def _outcome(t):
        return G.delete_outcome(t, entity, t.get(table).select("id"))


for _entity in _USES:
    _register_uses(_entity)
    _register_whole(_entity)


# ---------------------------------------------------------------- L10
# Per entity: its table, required columns other than code and name, foreign keys.
_MASTER = {
    "district": ("districts", [], []),
    "route": ("routes", ["town_id"], ["town_id"]),
    "product": ("products", ["unit_price"], []),
    "category": ("product_categories", [], []),
    "salesperson": ("salespersons", [], []),
    "shop": ("shops", [], ["district_id", "town_id", "route_id"]),
}


def _messy_fk(fk: str, step: int) -> str:
    return f"""case when id % {step} = 1 then concat('r', cast({fk} as varchar(20))) when id % {step} = 2 then ' '
  when id % {step} = 3 then null else concat(' ', cast({fk} as varchar(20)), ' ') end"""


def _messy_columns(entity: str) -> dict[str, str]:
    """Columns of rows as a user might type them, as SQL that both engines read."""
    _, required, fks = _MASTER[entity]
    cols = {"code": "case when id % 9 = 4 then ' ' when id % 9 = 5 then null else concat(' ', lower(code), ' ') end",
            "name": "case when id % 10 = 7 then '  ' else concat('  ', name, ' ') end"}
    cols |= {fk: _messy_fk(fk, 5 + 2 * i) for i, fk in enumerate(fks)}
    if "unit_price" in required:
        cols["unit_price"] = "case when id % 8 = 2 then null else unit_price end"
    if entity == "category":
        cols["value"] = "case when id % 4 = 1 then null when id % 4 = 2 then ' ' else concat(' ', upper(value)) end"
    return cols


def _master_oracle(entity: str) -> str:
    table, required, fks = _MASTER[entity]
    raw = ", ".join(f"{e} as {c}" for c, e in _messy_columns(entity).items())
    asked = ["code", "name", *required]
    blank = [f"case when {c} is null or trim(cast({c} as varchar)) = '' then '{c} is required' end" for c in asked]
    wrong = [f"case when trim({c}) <> '' and try_cast(trim({c}) as bigint) is null then '{c} is not an integer' end" for c in fks]
    out = ["upper(trim(code)) as code", "trim(name) as name", *[f"try_cast(trim({c}) as bigint) as {c}" for c in fks]]
    if "unit_price" in required:
        out.append("cast(unit_price as double) as unit_price")
    if entity == "category":
        out.append("lower(coalesce(nullif(trim(value), ''), upper(trim(code)))) as value")
    return sql(f"""select id, {', '.join(out)}, nullif(concat_ws('; ', {', '.join(blank + wrong)}), '') as reason
from (select id, {raw} from {table}) raw""", table)


def _register_master(entity: str) -> None:
    table = _MASTER[entity][0]

    @register(f"normalise_all_{table}", "L10", _master_oracle(entity))
    def _all(t) -> DataFrame:
        typed = t.get(table).selectExpr("id", *[f"{e.replace('varchar(20)', 'string')} as {c}" for c, e in _messy_columns(entity).items()])
        good, bad = G.normalise_master(typed, entity)
        out = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
        return out.withColumn("unit_price", F.col("unit_price").cast("double")) if "unit_price" in out.columns else out


for _entity in _MASTER:
    _register_master(_entity)


# ---------------------------------------------------------------- L8
_NEXT = "(select max(id) from products)"


def _upserts(t) -> DataFrame:
    """Promo products at a new price, standard ones as new products, small ones given twice, large ones without a key."""
    p, last = t.products, t.products.agg(F.max("id").alias("m"))
    kind = F.lower("category")
    pick = lambda like, key: p.filter(kind.startswith(like)).crossJoin(last).select(  # noqa: E731  one row on the right
        key.cast("bigint").alias("id"), F.upper("name").alias("name"), F.expr("unit_price + 1").alias("unit_price"))
    small = pick("small", F.col("id"))
    return (pick("promo", F.col("id")).unionByName(pick("standard", F.col("id") + F.col("m"))).unionByName(small).unionByName(small)
            .unionByName(pick("large", F.lit(None))))


@register("merge_products_upsert", "L8", sql(f"""
select id, code, case when lower(category) like 'promo%' then upper(name) else name end as name,
  cast(case when lower(category) like 'promo%' then unit_price + 1 else unit_price end as double) as unit_price from products
union all
select id + {_NEXT}, null, upper(name), cast(unit_price + 1 as double) from products where lower(category) like 'standard%'""", "products"))
def _l8_upsert(t):
    return G.merge_records(t.products, _upserts(t)).select("id", "code", "name", F.col("unit_price").cast("double").alias("unit_price"))


@register("merge_products_rejects", "L8", sql("""
select id, cast(2 as bigint) as rows, 'key given more than once' as reason from products where lower(category) like 'small%'
union all
select null, count(*), 'key missing' from products where lower(category) like 'large%' having count(*) > 0""", "products"))
def _l8_rejects(t):
    return G.merge_rejects(_upserts(t))


# ---------------------------------------------------------------- L6
@register("apply_levels_rejects", "L6", sql(f"""
select resource, k1, k2, cast(sum(delta) as double) as delta,
  case when resource not in ('warehouse', 'field', 'debt') then 'unknown resource'
       when k1 is null or (resource = 'field' and k2 is null) then 'key missing' else 'not found' end as reason
from (select case when ts >= timestamp '1998-06-01 00:00:00' and resource = 'field' then 'van' else resource end as resource,
        case when k1 % 13 = 5 then null else k1 end as k1, k2, delta from ({_MOVES}) m) d
where not (resource = 'field' and k1 is not null and k2 is not null)
  and not (resource = 'warehouse' and coalesce(k1 in (select id from products where is_active = 1), false))
  and not (resource = 'debt' and coalesce(k1 in (select id from shops where is_active = 1), false))
group by resource, k1, k2""", *MOVE_TABLES, "products", "shops"))
def _l6_rejects(t):
    # Movements against a bundle without its inactive products and shops, some without a key or of an unknown resource.
    active = t.with_tables(products=t.products.filter("is_active = 1"), shops=t.shops.filter("is_active = 1"))
    deltas = movements(t).select(
        F.when((F.col("ts") >= F.lit("1998-06-01").cast("timestamp_ntz")) & (F.col("resource") == "field"), "van")
        .otherwise(F.col("resource")).alias("resource"),
        F.when(F.col("k1") % 13 == 5, None).otherwise(F.col("k1")).alias("k1"), "k2", "delta")
    return G.level_rejects(active, deltas).withColumn("delta", F.col("delta").cast("double"))
