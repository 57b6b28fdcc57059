"""U1..U3: set operations (UNION ALL by name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_date, contains_ci, day_of, to_double
from ..schema import MONEY
from ..tables import Tables
from .reports import _names


def _movement_day(df: DataFrame, t: Tables, qty: str, kind: str, day, extra=()) -> DataFrame:
    d = df.filter(day_of("date") == as_date(day)).select("id", "date", "salesperson_id", "product_id", qty, *extra)
    d = _names(d, t.products, "product_id", product_name="name", _price="unit_price")
    d = _names(d, t.salespersons, "salesperson_id", salesperson_name="name")
    return d.select("id", "date", F.lit(kind).alias("type"), F.col(qty).alias("quantity"),
                    to_double(F.col(qty) * F.col("_price")).alias("value"), "product_name", "salesperson_name",
                    *extra)


def recent_activity(t: Tables, date) -> DataFrame:
    """The day's issues and returns, newest first; issues carry no reason."""
    issues = _movement_day(t.stock_issues, t, "quantity_issued", "issue", date)
    returns = _movement_day(t.stock_returns, t, "quantity_returned", "return", date, extra=("reason",))
    out = issues.unionByName(returns, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last("date"), "type", "id", "product_name", "salesperson_name", "quantity")


def search_all(t: Tables, term: str, k: int = 5) -> DataFrame:
    """First k matching products, salespersons and shops (by code, id).

    Each side is a bounded top-k; shops also match on owner and ignore the
    active flag, as in the reference."""
    def top(df: DataFrame, kind: str, cols, active: bool) -> DataFrame:
        pred = contains_ci(cols[0], term)
        for c in cols[1:]:
            pred = pred | contains_ci(c, term)
        if active:
            pred = pred & (F.col("is_active") == 1)
        return (df.filter(pred).select(F.lit(kind).alias("type"), "id", "code", "name")
                .orderBy(F.asc_nulls_last("code"), "id").limit(k))
    return (top(t.products, "product", ["code", "name"], True)
            .unionByName(top(t.salespersons, "salesperson", ["code", "name"], True))
            .unionByName(top(t.shops, "shop", ["code", "name", "owner_name"], False)))


def movements(t: Tables, resources=("warehouse", "field", "debt")) -> DataFrame:
    """Every ledger leg in one long table.

    Resources: ``warehouse`` (k1 = product), ``field`` (k1 = salesperson,
    k2 = product) and ``debt`` (k1 = shop; debt = -balance).  ``k2`` is -1
    where unused so joins on (resource, k1, k2) stay null-free.  Each source
    table is scanned once (its legs come out of one ``explode``), and a
    source is not read at all when none of its resources is asked for."""
    want = set(resources)
    none = F.lit(-1).cast("bigint")

    def leg(resource, k1, k2, delta):
        return F.struct(F.lit(resource).alias("resource"), k1.cast("bigint").alias("k1"),
                        k2.cast("bigint").alias("k2"), delta.cast(MONEY).alias("delta"))

    def legs(df, source, sid, ts, parts):
        parts = [p for r, p in parts if r in want]
        if not parts:
            return None
        return (df.select(F.lit(source).alias("source"), sid.cast("bigint").alias("source_id"), ts.alias("ts"),
                          F.explode(F.array(*parts)).alias("_l"))
                .select("source", "source_id", "ts", "_l.*"))

    i, r = t.stock_issues, t.stock_returns
    q_i, q_r = F.col("quantity_issued"), F.col("quantity_returned")
    sp, p = F.col("salesperson_id"), F.col("product_id")
    out = [
        legs(i, "issue", F.col("id"), F.col("date"),
             [("warehouse", leg("warehouse", p, none, -q_i)), ("field", leg("field", sp, p, q_i))]),
        legs(r, "return", F.col("id"), F.col("date"),
             [("field", leg("field", sp, p, -q_r)), ("warehouse", leg("warehouse", p, none, q_r))]),
    ]
    if "field" in want:
        items = t.sale_items.select("sale_id", "product_id", "quantity").join(
            t.sales.select(F.col("id").alias("sale_id"), "date", "salesperson_id"), "sale_id")
        out.append(legs(items, "sale", F.col("sale_id"), F.col("date"),
                        [("field", leg("field", sp, p, -F.col("quantity")))]))
    if "debt" in want:
        credit = t.sales.filter(F.col("balance_amount") > 0)
        out.append(legs(credit, "sale", F.col("id"), F.col("date"),
                        [("debt", leg("debt", F.col("shop_id"), none, F.col("balance_amount")))]))
        out.append(legs(t.collections, "collection", F.col("id"), F.col("date"),
                        [("debt", leg("debt", F.col("shop_id"), none, -F.col("amount")))]))
    out = [o for o in out if o is not None]
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
