"""C1..C8: integrity and reconciliation checks, each returning violating rows.

All run over whole tables with joins and aggregations; results are small
(violations), inputs are not collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import to_double
from ..functions.windows import running_total, split_hot
from ..tables import Tables
from .activity import movements
from .ledger import KEYS, positions, state_levels


# ---------------------------------------------------------------- C1
def negative_stock(t: Tables) -> DataFrame:
    """Stored warehouse or field stock below zero."""
    lv = state_levels(t).filter(F.col("resource").isin("warehouse", "field") & (F.col("level") < 0))
    return lv.select(*KEYS, to_double(F.col("level")).alias("level"))


def negative_positions(t: Tables, as_of=None) -> DataFrame:
    """C1 on the ledger: positions (from zero) below zero."""
    p = positions(t, as_of, resources=("warehouse", "field")).filter(F.col("level") < 0)
    return p.select(*KEYS, to_double(F.col("level")).alias("level"))


# ---------------------------------------------------------------- C2
def first_negative(t: Tables, opening: DataFrame | None = None) -> DataFrame:
    """For each position, the first timestamp at whose end the level
    (opening + movements so far) is below zero, and that level.

    Movements are summed per (key, timestamp) first; the running level uses
    the range-split prefix sum, so a hot key does not serialise one task."""
    neg = levels_below_zero(movements(t), opening)
    return neg.select(*KEYS, "first_negative_ts", to_double(F.col("level_then")).alias("level_then"))


def levels_below_zero(legs: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """C2 on any legs: (KEYS, first_negative_ts, level_then) with exact levels."""
    rows = legs.select(*KEYS, "ts", "delta", F.lit(1).alias("_turn"))
    if opening is not None:  # before the first leg, undated ones too
        rows = rows.unionByName(opening.select(*KEYS, F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("level").cast("decimal(28,2)").alias("delta"),
                                               F.lit(0).alias("_turn")))
    cold, hot = split_hot(rows, KEYS, counted=legs)
    # By key alone, so that the sums, the running sums and the first of a key share one shuffle.
    per_ts = lambda df: df.groupBy(*KEYS, "_turn", "ts").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy(*KEYS).orderBy("_turn", "ts").rowsBetween(Window.unboundedPreceding, 0)
    run = per_ts(cold.repartition(*KEYS)).select(*KEYS, "_turn", "ts", F.coalesce(F.sum("delta").over(w), F.lit(0)).alias("_run"))
    out = _first_below_zero(run)
    if hot is not None:
        out = out.unionByName(_first_below_zero(running_total(per_ts(hot), KEYS, ["_turn", "ts"], "delta", out="_run")))
    return out


def _first_below_zero(run: DataFrame) -> DataFrame:
    neg = run.filter((F.col("_turn") == 1) & (F.col("_run") < 0))
    return (neg.groupBy(*KEYS)
            .agg(F.min_by(F.struct("ts", "_run"), "ts").alias("_first"))
            .select(*KEYS, F.col("_first.ts").alias("first_negative_ts"), F.col("_first._run").alias("level_then")))


# ---------------------------------------------------------------- C3
# The declared foreign keys (child table, column, parent table).
FOREIGN_KEYS = [
    ("towns", "district_id", "districts"), ("routes", "town_id", "towns"),
    ("shops", "district_id", "districts"), ("shops", "town_id", "towns"), ("shops", "route_id", "routes"),
    ("sales", "shop_id", "shops"), ("sales", "salesperson_id", "salespersons"), ("sales", "route_id", "routes"),
    ("sale_items", "sale_id", "sales"), ("sale_items", "product_id", "products"),
    ("collections", "shop_id", "shops"), ("collections", "salesperson_id", "salespersons"),
    ("salesperson_stock", "salesperson_id", "salespersons"), ("salesperson_stock", "product_id", "products"),
    ("stock_issues", "salesperson_id", "salespersons"), ("stock_issues", "product_id", "products"),
    ("stock_returns", "salesperson_id", "salespersons"), ("stock_returns", "product_id", "products"),
]


def orphan_keys(t: Tables) -> DataFrame:
    """Foreign-key values with no parent row, with the number of child rows.

    Child keys are counted per value before the anti join, so the join and
    the result are one row per distinct value."""
    parts = []
    for child, col, parent in FOREIGN_KEYS:
        vals = (t.get(child).filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
                .agg(F.count(F.lit(1)).alias("rows")))
        ids = t.get(parent).select(F.col("id").alias("value"))
        parts.append(vals.join(ids, "value", "left_anti").select(
            F.lit(child).alias("table"), F.lit(col).alias("column"), "value", "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- C4
# The declared unique keys.
_UNIQUE = [("districts", ["code"]), ("towns", ["code"]), ("routes", ["code"]), ("products", ["code"]),
           ("salespersons", ["code"]), ("shops", ["code"]), ("product_categories", ["code"]), ("product_categories", ["value"]),
           ("salesperson_stock", ["salesperson_id", "product_id"])]


def duplicate_keys(t: Tables) -> DataFrame:
    """C4: duplicate unique keys (codes, category values, and (salesperson, product)
    pairs).  A key with a NULL part is equal to no other."""
    parts = []
    for table, cols in _UNIQUE:
        full = t.get(table).dropna(subset=cols)
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        parts.append(full.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
                     .select(F.lit(table).alias("table"), F.lit(",".join(cols)).alias("columns"), key.alias("key"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- C5
def invalid_facts(t: Tables) -> DataFrame:
    """Fact rows with a non-positive quantity/amount or a missing required field.

    One output row per (row, broken rule)."""
    def rules(df, table, ref, checks):
        arr = F.filter(F.array(*[F.when(cond, F.lit(msg)) for msg, cond in checks]), lambda x: x.isNotNull())
        return (df.select(F.lit(table).alias("table"), ref.cast("bigint").alias("ref_id"), arr.alias("_r"))
                .select("table", "ref_id", F.explode("_r").alias("rule")))

    q = F.col
    parts = [
        rules(t.sales, "sales", q("id"), [("total_amount missing", q("total_amount").isNull()),
                                          ("shop_id missing", q("shop_id").isNull()),
                                          ("salesperson_id missing", q("salesperson_id").isNull()),
                                          ("negative amount", (q("paid_amount") < 0) | (q("balance_amount") < 0))]),
        rules(t.sale_items, "sale_items", q("sale_id"), [("quantity not positive", ~F.coalesce(q("quantity") > 0, F.lit(False))),
                                                         ("product_id missing", q("product_id").isNull())]),
        rules(t.collections, "collections", q("id"), [("amount not positive", ~F.coalesce(q("amount") > 0, F.lit(False))),
                                                      ("shop_id missing", q("shop_id").isNull()),
                                                      ("salesperson_id missing", q("salesperson_id").isNull())]),
        rules(t.stock_issues, "stock_issues", q("id"), [("quantity not positive", ~F.coalesce(q("quantity_issued") > 0, F.lit(False)))]),
        rules(t.stock_returns, "stock_returns", q("id"), [("quantity not positive", ~F.coalesce(q("quantity_returned") > 0, F.lit(False)))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- C6
def credit_breaches(t: Tables) -> DataFrame:
    """Shops whose debt exceeds their credit limit (never enforced on sale)."""
    s = t.shops.filter(-F.col("current_balance") > F.col("credit_limit"))
    return s.select("id", "code", "name", to_double(-F.col("current_balance")).alias("debt"),
                    to_double(F.col("credit_limit")).alias("credit_limit"),
                    to_double(-F.col("current_balance") - F.col("credit_limit")).alias("excess"))


# ---------------------------------------------------------------- C7
def reconcile(t: Tables, opening: DataFrame | None = None) -> DataFrame:
    """Stored state vs ledger positions; rows where they differ."""
    stored = state_levels(t).groupBy(*KEYS).agg(F.sum("level").alias("_s"))
    ledger = positions(t, opening=opening).withColumnRenamed("level", "_l")
    j = stored.join(ledger, KEYS, "full")
    s, l_ = F.coalesce("_s", F.lit(0)), F.coalesce("_l", F.lit(0))
    return j.filter(s != l_).select(*KEYS, to_double(s).alias("stored"), to_double(l_).alias("ledger"),
                                    to_double(s - l_).alias("difference"))


# ---------------------------------------------------------------- C8
def sale_mismatches(t: Tables) -> DataFrame:
    """Sale headers whose total differs from the sum of their lines, or
    whose paid + balance differs from the total."""
    lines = t.sale_items.groupBy(F.col("sale_id").alias("id")).agg(F.sum("total_price").alias("_lines"))
    s = t.sales.select("id", "total_amount", "paid_amount", "balance_amount").join(lines, "id", "left")
    lines_total = F.coalesce("_lines", F.lit(0))
    bad_lines = F.col("total_amount") != lines_total
    bad_split = (F.coalesce("paid_amount", F.lit(0)) + F.coalesce("balance_amount", F.lit(0))) != F.col("total_amount")
    return s.filter(bad_lines | bad_split).select(
        "id", to_double(F.col("total_amount")).alias("total_amount"), to_double(lines_total).alias("lines_total"),
        bad_lines.alias("lines_differ"), bad_split.alias("split_differs"))
