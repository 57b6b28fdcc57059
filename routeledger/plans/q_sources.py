"""Registered source/sink round trips (S1, S2, S4, S5) with oracle SQL.

Each writes data derived from the driver tables into the shared checkpoint
folder, reads it back through the operator under test and returns the
read-back rows, so the check covers the write and the typed read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports as R
from ..schema import SCHEMAS
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.tables import load_star, load_table, parse_table, save_star, save_text
from ..sources.testdata import star_from_testdata
from ..tables import Tables
from .catalog import FROM, TO, _between, _m, register
from .oracle_base import sql
from .q_reports import _RISK


def _scratch(spark, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/routeledger/{label}-{uuid.uuid4().hex}"


@register("stored_products", "S1", sql("""
select id, code, name, cast(unit_price as double) as unit_price, cast(0 as double) as cost_price, stock_quantity,
  cast(0 as bigint) as max_stock_level, unit, category, cast(null as varchar) as brand, is_active
from products""", "products"), raw=True)
def _s1(spark, sf_dir):
    # An older file of the table: written without cost_price, max_stock_level
    # and brand, and with the price as text.  S1 reads it typed, S2 fills the
    # column defaults and casts.
    t = star_from_testdata(spark, sf_dir)
    path = _scratch(spark, "stored-products")
    (t.products.select("id", "code", "name", F.col("unit_price").cast("string").alias("unit_price"),
                       "stock_quantity", "min_stock_level", "unit", "category", "is_active")
     .write.parquet(path))
    p = load_table(spark, path, "products")
    assert [f.name for f in p.schema.fields] == [f.name for f in SCHEMAS["products"].fields]
    return p.select("id", "code", "name", F.col("unit_price").cast("double").alias("unit_price"),
                    F.col("cost_price").cast("double").alias("cost_price"), "stock_quantity", "max_stock_level",
                    "unit", "category", "brand", "is_active")


@register("report_csv_roundtrip", "S4", sql(f"""
select s.id as shop_id, s.name as shop_name, s.owner_name, cast(null as varchar) as contact_number,
  {_m("s.current_balance", "current_balance")}, {_m("s.credit_limit", "credit_limit")},
  r.name as route_name, t.name as town_name, d.name as district_name, {_RISK} as risk_level
from shops s left join routes r on s.route_id = r.id left join towns t on s.town_id = t.id
left join districts d on s.district_id = d.id
where s.current_balance < 0""", "shops", "routes", "towns", "districts"), raw=True)
def _s4(spark, sf_dir):
    report = R.shop_outstanding(star_from_testdata(spark, sf_dir))
    path = _scratch(spark, "report-csv")
    sinks.write_report_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@register("snapshot_sales", "S5", sql(f"""
select id, date, shop_id, salesperson_id, {_m("total_amount", "total_amount")}
from sales where {_between("date", FROM, TO)}""", "sales"), raw=True)
def _s5(spark, sf_dir):
    t = star_from_testdata(spark, sf_dir)
    root = _scratch(spark, "snapshots")
    now = dt.datetime(2024, 7, 1, 12, 0)
    old = sinks.snapshot(t, root, now - dt.timedelta(days=45))
    tag = sinks.snapshot(t, root, now)
    dropped = sinks.expire(spark, root, 30, now)
    assert dropped == [old] and sinks.list_snapshots(spark, root) == [tag]
    s = sinks.read_snapshot(spark, root, "sales", tag)
    return (s.filter(F.to_date("date").between(F.lit(FROM).cast("date"), F.lit(TO).cast("date")))
            .select("id", "date", "shop_id", "salesperson_id", F.col("total_amount").cast("double").alias("total_amount")))


# Columns that the driver tables fill, per table; times are compared to the second.
_FILLED = {
    "districts": "id code name",
    "towns": "id code name district_id",
    "routes": "id code name town_id",
    "products": "id code name unit_price stock_quantity min_stock_level category brand unit is_active",
    "product_categories": "id code value name",
    "salespersons": "id code name vehicle_number target_amount commission_rate is_active",
    "shops": "id code name owner_name district_id town_id route_id credit_limit current_balance is_active",
    "sales": "id date shop_id salesperson_id route_id total_amount paid_amount balance_amount payment_type payment_method",
    "sale_items": "sale_id product_id quantity total_price",
    "collections": "id date shop_id salesperson_id amount payment_method",
    "salesperson_stock": "salesperson_id product_id quantity",
    "stock_issues": "date salesperson_id product_id quantity_issued vehicle_number",
    "stock_returns": "date salesperson_id product_id quantity_returned reason condition inspection_required notes",
}


def _digests(t: Tables, only=None, **more) -> DataFrame:
    """(table_name, column_name, n_rows, n_given, digest) of every filled column (of the tables ``only``): the digest is the
    sum of the first 32 bits of the values' MD5, so it doesn't depend on the order of the rows."""
    parts = []
    for name, cols in _FILLED.items():
        if only is not None and name not in only:
            continue
        df, aggs, out = t.get(name), [F.count(F.lit(1)).alias("_n")], []
        for c in cols.split():
            text = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "date" else F.col(c).cast("string")
            bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
            aggs += [F.count(c).alias(f"_g_{c}"), F.coalesce(F.sum(bits), F.lit(0)).alias(f"_d_{c}")]
            out.append(F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"),
                                F.col(f"_g_{c}").alias("n_given"), F.col(f"_d_{c}").alias("digest")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*out))))
    return reduce(DataFrame.unionByName, parts).select(*[F.lit(v).alias(k) for k, v in more.items()], "*")


def _digest_sql(changed: dict[tuple[str, str], str] | None = None) -> str:
    parts = []
    for name, cols in _FILLED.items():
        for c in cols.split():
            col = (changed or {}).get((name, c), c)
            text = f"strftime(cast({col} as timestamp), '%Y-%m-%d %H:%M:%S')" if c == "date" else f"cast({col} as varchar)"
            parts.append(f"select '{name}' as table_name, '{c}' as column_name, count(*) as n_rows, count({col}) as n_given, "
                         f"cast(coalesce(sum(cast('0x' || substr(md5({text}), 1, 8) as bigint)), 0) as bigint) as digest from {name}")
    return "\nunion all ".join(parts)


@register("stored_tables", "S1", sql(f"select f.fmt, d.* from ({_digest_sql()}) d, (values ('parquet'), ('csv'), ('json')) f(fmt)",
                                     *_FILLED), raw=True)
def _s1_all(spark, sf_dir):
    # All tables written in three formats and read back typed.
    t = star_from_testdata(spark, sf_dir)
    root = _scratch(spark, "stored-tables")
    save_star(t, f"{root}/parquet")
    kept = load_star(spark, f"{root}/parquet")
    out = [_digests(kept, fmt="parquet")]
    for fmt in ("csv", "json"):
        save_text(kept, f"{root}/{fmt}", fmt)
        out.append(_digests(Tables(**{n: parse_table(spark, f"{root}/{fmt}/{n}", n, fmt)[0] for n in Tables.names()}), fmt=fmt))
    return reduce(DataFrame.unionByName, out)


_CUT, _WRONG = "id % 11 = 0", "id % 7 = 3"


@register("parse_rejects", "S2", sql(f"""
select 'row' as kind, id, shop_id, cast(amount as double) as amount, cast(null as varchar) as record,
  cast(null as varchar) as bad_columns, cast(null as varchar) as reason
from collections where not ({_CUT}) and not ({_WRONG})
union all
select 'reject', null, null, null, concat('{{"id":', cast(id as varchar), ',"shop_id":'), '', 'not a record'
from collections where {_CUT}
union all
select 'reject', null, null, null, concat('{{"id":', cast(id as varchar), ',"shop_id":', cast(shop_id as varchar),
  ',"amount":"x', cast(amount as varchar), '"}}'), 'amount', 'value of another type'
from collections where {_WRONG} and not ({_CUT})""", "collections"), raw=True)
def _s2(spark, sf_dir):
    # The collections as JSON lines; some lines end early, some amounts are no numbers.
    c = star_from_testdata(spark, sf_dir).collections
    start = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"shop_id":'))
    rest = F.concat(F.col("shop_id").cast("string"), F.lit(',"amount":'),
                    F.when(F.expr(_WRONG), F.concat(F.lit('"x'), F.col("amount").cast("string"), F.lit('"')))
                    .otherwise(F.col("amount").cast("string")), F.lit("}"))
    path = _scratch(spark, "collection-lines")
    c.select(F.when(F.expr(_CUT), start).otherwise(F.concat(start, rest)).alias("value")).write.text(path)
    rows, rejects = parse_table(spark, path, "collections", "json")
    none = F.lit(None).cast("string")
    good = rows.select(F.lit("row").alias("kind"), "id", "shop_id", F.col("amount").cast("double").alias("amount"),
                       none.alias("record"), none.alias("bad_columns"), none.alias("reason"))
    return good.unionByName(rejects.select(F.lit("reject").alias("kind"), "record", F.array_join("bad_columns", ",").alias("bad_columns"), "reason"),
                            allowMissingColumns=True)


@register("snapshot_tables", "S5", sql(f"""
select 'first' as snapshot, d.*, false as written_again from ({_digest_sql()}) d
union all
select 'second', d.*, d.table_name = 'products'
from ({_digest_sql({("products", "stock_quantity"): "stock_quantity + 1"})}) d""", *_FILLED), raw=True)
def _s5_all(spark, sf_dir):
    # Every table twice, the stock changed in between: only products is written again, the others are shared.
    t = star_from_testdata(spark, sf_dir)
    root = _scratch(spark, "snapshots")
    now = dt.datetime(2024, 7, 1, 12, 0)
    tags = [sinks.snapshot(t, root, now - dt.timedelta(days=45)), sinks.snapshot(t, root, now - dt.timedelta(days=10))]
    changed = t.with_tables(products=t.products.withColumn("stock_quantity", F.col("stock_quantity") + 1))
    tags.append(sinks.snapshot(changed, root, now))
    dropped = sinks.expire(spark, root, 30, now)
    assert dropped == tags[:1] and sinks.list_snapshots(spark, root) == tags[1:]
    first, second = (sinks.snapshot_versions(spark, root, tag) for tag in tags[1:])
    again = [n for n in Tables.names() if first[n] != second[n]]
    # A version that both snapshots name is one set of files: it is read and digested once, for both.
    old, new = sinks.load_snapshot(spark, root, tags[1]), sinks.load_snapshot(spark, root, tags[2])
    shared = [n for n in _FILLED if n not in again]
    own = [n for n in _FILLED if n in again]
    out = [_digests(old, shared).select(F.explode(F.array(F.lit("first"), F.lit("second"))).alias("snapshot"), "*")] if shared else []
    if own:
        out += [_digests(old, own, snapshot="first"), _digests(new, own, snapshot="second")]
    return reduce(DataFrame.unionByName, out).withColumn("written_again", (F.col("snapshot") == "second") & F.col("table_name").isin(again))
