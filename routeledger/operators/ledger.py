"""L1, L2, L6..L12: ledger positions, statements and batch state changes.

Resources (see ``activity.movements``): ``warehouse`` (k1 = product),
``field`` (k1 = salesperson, k2 = product), ``debt`` (k1 = shop,
debt = -current_balance).  State changes are computed as new DataFrames
(a new version of a table), never as in-place updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import category_key, id_frame
from ..functions.scalars import as_date, norm_code, norm_name, to_double, to_id
from ..functions.windows import dense_ids, running_total
from ..schema import MONEY
from ..tables import Tables
from .activity import movements
from .reports import entity_usage

KEYS = ["resource", "k1", "k2"]


def _no_key() -> Column:
    return F.lit(-1).cast("bigint")


# ---------------------------------------------------------------- state as levels
def state_levels(t: Tables) -> DataFrame:
    """Stored state in level form (resource, k1, k2, level DECIMAL)."""
    wh = t.products.select(F.lit("warehouse").alias("resource"), F.col("id").alias("k1"), _no_key().alias("k2"),
                           F.col("stock_quantity").cast(MONEY).alias("level"))
    fd = t.salesperson_stock.select(F.lit("field").alias("resource"), F.col("salesperson_id").alias("k1"),
                                    F.col("product_id").alias("k2"), F.col("quantity").cast(MONEY).alias("level"))
    dt = t.shops.select(F.lit("debt").alias("resource"), F.col("id").alias("k1"), _no_key().alias("k2"),
                        (-F.col("current_balance")).cast(MONEY).alias("level"))
    return wh.unionByName(fd).unionByName(dt)


# ---------------------------------------------------------------- L1
def positions(t: Tables, as_of=None, opening: DataFrame | None = None,
              resources=("warehouse", "field", "debt")) -> DataFrame:
    """L1: level per (resource, key) = opening level + movements up to ``as_of``.

    One aggregation on (resource, k1, k2) with map-side partial sums; the
    optional opening levels join on the same key."""
    m = movements(t, resources)
    if as_of is not None:
        m = m.filter(F.to_date("ts") <= as_of_date(as_of))
    moved = m.groupBy(*KEYS).agg(F.sum("delta").alias("_moved"))
    if opening is None:
        out = moved.select(*KEYS, F.col("_moved").alias("level"))
    else:
        o = opening.select(*KEYS, F.col("level").cast(MONEY).alias("_open"))
        out = o.join(moved, KEYS, "full").select(
            *KEYS, (F.coalesce("_open", F.lit(0)) + F.coalesce("_moved", F.lit(0))).alias("level"))
    return out


def as_of_date(v) -> Column:
    return as_date(v)


# ---------------------------------------------------------------- L2
def shop_statement(t: Tables, ids=None) -> DataFrame:
    """L2: chronological debt statement per shop with the running debt.

    The running sum is split by ranges, so a shop with most of the history is
    still spread over many tasks (``windows.running_total``); rows with a NULL
    date come first, and rows with a NULL shop are a statement of their own."""
    legs = movements(t, ["debt"]).select(
        F.col("k1").alias("shop_id"), "ts", "source", "source_id", "delta")
    if ids is not None:
        legs = legs.join(id_frame(legs.sparkSession, ids, "shop_id"), "shop_id", "left_semi")
    out = running_total(legs, ["shop_id"], ["ts", "source", "source_id"], "delta",
                        out="running_debt")
    return out.select("shop_id", "ts", "source", "source_id", to_double(F.col("delta")).alias("delta"),
                      to_double(F.col("running_debt")).alias("running_debt")).orderBy(
        "shop_id", "ts", "source", "source_id")


# ---------------------------------------------------------------- L6
def apply_levels(t: Tables, deltas: DataFrame) -> Tables:
    """New state tables = old state + summed deltas (field stock is upserted).

    ``deltas``: (resource, k1, k2, delta).  Deltas are summed per key first,
    so each state table meets one row per key in a single join.  A delta of a
    product or shop that isn't there changes nothing: ``level_rejects``."""
    d = deltas.groupBy(*KEYS).agg(F.sum("delta").alias("_d"))
    wh = d.filter(F.col("resource") == "warehouse").select(F.col("k1").alias("id"), "_d")
    products = t.products.join(wh, "id", "left").withColumn(
        "stock_quantity", (F.col("stock_quantity") + F.coalesce("_d", F.lit(0))).cast("bigint")).drop("_d")
    fd = d.filter("resource = 'field' and k1 is not null and k2 is not null").select(
        F.col("k1").alias("salesperson_id"), F.col("k2").alias("product_id"), "_d")
    ss = t.salesperson_stock.join(fd, ["salesperson_id", "product_id"], "full").withColumn(
        "quantity", (F.coalesce("quantity", F.lit(0)) + F.coalesce("_d", F.lit(0))).cast("bigint")).drop("_d")
    ss = ss.select(*t.salesperson_stock.columns)
    dt = d.filter(F.col("resource") == "debt").select(F.col("k1").alias("id"), "_d")
    shops = t.shops.join(dt, "id", "left").withColumn(
        "current_balance", (F.col("current_balance") - F.coalesce("_d", F.lit(0))).cast(MONEY)).drop("_d")
    return t.with_tables(products=products.select(*t.products.columns), salesperson_stock=ss,
                         shops=shops.select(*t.shops.columns))


def level_rejects(t: Tables, deltas: DataFrame) -> DataFrame:
    """What ``apply_levels`` cannot apply, summed per key: (resource, k1, k2, delta, reason).

    Warehouse deltas of absent products, debt deltas of absent shops, unknown
    resources and keys that are NULL.  Field stock is upserted and refuses only NULL keys."""
    d = deltas.groupBy(*KEYS).agg(F.sum("delta").alias("delta"))
    there = (t.products.select(F.lit("warehouse").alias("resource"), F.col("id").alias("k1"))
             .unionByName(t.shops.select(F.lit("debt").alias("resource"), F.col("id").alias("k1"))))
    absent = d.filter(~F.col("resource").eqNullSafe("field")).join(there, ["resource", "k1"], "left_anti")
    absent = absent.unionByName(d.filter("resource = 'field' and (k1 is null or k2 is null)"))
    known = F.coalesce(F.col("resource").isin("warehouse", "field", "debt"), F.lit(False))
    missing = F.col("k1").isNull() | ((F.col("resource") == "field") & F.col("k2").isNull())
    return absent.select(*KEYS, "delta", F.when(~known, "unknown resource").when(missing, "key missing")
                         .otherwise("not found").alias("reason"))


# ---------------------------------------------------------------- L7
def append_facts(base: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Append ``new`` rows with ids continuing after ``max(base.id)``,
    numbered in ``order`` (a total order) without a single-task window."""
    base_max = base.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).scalar()
    numbered = dense_ids(new, order, base_max, id_col)
    return base.unionByName(numbered.select(*base.columns), allowMissingColumns=False)


# ---------------------------------------------------------------- L8
def merge_records(base: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Batch update/insert by key; only the columns present in
    ``updates`` change (a NULL given there is written as NULL).  Keys not in
    ``base`` are inserted with the other columns NULL.  A key given twice or not
    at all changes nothing: such rows are refused (``merge_rejects``)."""
    upd_cols = [c for c in updates.columns if c != key]
    once = updates.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(key)
    updates = updates.join(once, key, "left_semi")
    u = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in upd_cols])
    b = base.withColumn("_in_base", F.lit(True))
    j = b.join(u, key, "full")
    cols = []
    for c in base.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in upd_cols:
            cols.append(F.when(F.col("_hit"), F.col(f"_u_{c}").cast(base.schema[c].dataType))
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def merge_rejects(updates: DataFrame, key: str = "id") -> DataFrame:
    """Keys of an update batch that ``merge_records`` refuses, with the reason."""
    n = updates.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return n.filter((F.col("rows") > 1) | F.col(key).isNull()).select(
        key, "rows", F.when(F.col(key).isNull(), "key missing").otherwise("key given more than once").alias("reason"))


# ---------------------------------------------------------------- L9
_REFUSAL = {
    # Which usage blocks a hard delete, per entity.
    "shop": {"sale_count": "has sales", "collection_count": "has collections"},
    "salesperson": {"stock_count": "holds stock", "sale_count": "has sales", "collection_count": "has collections"},
    "district": {"town_count": "has towns"},
    "town": {"route_count": "has routes", "shop_count": "has shops"},
    "route": {"shop_count": "has shops", "sale_count": "has sales"},
}


def delete_outcome(t: Tables, entity: str, ids) -> DataFrame:
    """L9 decisions: products in use are deactivated (``soft``), unused ones
    removed (``hard``); other entities in use are ``refused`` with a reason."""
    usage = entity_usage(t, entity, ids)
    if entity == "product":
        return usage.select("id", F.when(F.col("in_use"), "soft").otherwise("hard").alias("action"),
                            F.lit(None).cast("string").alias("reason"))
    rules = _REFUSAL[entity]
    reasons = [F.when(F.col(c) > 0, F.lit(msg)) for c, msg in rules.items()]
    reason = F.concat_ws(", ", *reasons)
    return usage.select("id", F.when(F.col("in_use"), "refused").otherwise("deleted").alias("action"),
                        F.when(F.col("in_use"), reason).alias("reason"))


_ENTITY_TABLE = {"product": "products", "shop": "shops", "salesperson": "salespersons",
                 "district": "districts", "town": "towns", "route": "routes"}


def delete_records(t: Tables, entity: str, ids) -> tuple[Tables, DataFrame]:
    """Apply the decisions; returns the new tables and the outcome."""
    outcome = delete_outcome(t, entity, ids)
    table = _ENTITY_TABLE[entity]
    base = t.get(table)
    gone = outcome.filter(F.col("action").isin("hard", "deleted")).select("id")
    kept = base.join(gone, "id", "left_anti")
    changes = {table: kept}
    if entity == "product":
        soft = outcome.filter(F.col("action") == "soft").select("id", F.lit(0).alias("is_active"))
        changes[table] = merge_records(kept, soft)
        changes["salesperson_stock"] = t.salesperson_stock.join(
            gone.withColumnRenamed("id", "product_id"), "product_id", "left_anti")
    return t.with_tables(**changes), outcome


# ---------------------------------------------------------------- L10
# Required fields and integer foreign keys per master entity.
_MASTER_RULES = {
    "district": (["code", "name"], []),
    "town": (["code", "name", "district_id"], ["district_id"]),
    "route": (["code", "name", "town_id"], ["town_id"]),
    "product": (["code", "name", "unit_price"], []),
    "category": (["code", "name"], []),
    "salesperson": (["code", "name"], []),
    "shop": (["code", "name"], ["district_id", "town_id", "route_id"]),
}


def normalise_master(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """trim/upper codes, trim names, integer FKs; rows missing a
    required field or with a non-integer FK go to the reject frame with
    the reasons."""
    required, fks = _MASTER_RULES[entity]
    d = df
    if "code" in d.columns:
        d = d.withColumn("code", norm_code("code"))
    if entity == "category":  # the value defaults to the code and is kept in lower case
        given = F.trim(F.col("value")) if "value" in d.columns else F.lit(None).cast("string")
        d = d.withColumn("value", F.lower(F.coalesce(F.when(given != "", given), F.col("code"))))
    if "name" in d.columns:
        d = d.withColumn("name", norm_name("name"))
    checks = []
    raws = {}
    for fk in fks:
        if fk in d.columns:
            raw = F.trim(F.col(fk).cast("string"))
            d = d.withColumn(f"_raw_{fk}", raw).withColumn(fk, to_id(raw))
            raws[fk] = F.col(f"_raw_{fk}")
    for c in required:
        value = raws.get(c, F.col(c))
        checks.append(F.when(value.isNull() | (F.trim(value.cast("string")) == ""), F.lit(f"{c} is required")))
    for fk, raw in raws.items():
        checks.append(F.when(raw.isNotNull() & (raw != "") & F.col(fk).isNull(),
                             F.lit(f"{fk} is not an integer")))
    d = d.withColumn("_reasons", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    d = d.drop(*[f"_raw_{fk}" for fk in fks if fk in df.columns])
    good = d.filter(F.size("_reasons") == 0).drop("_reasons")
    bad = d.filter(F.size("_reasons") > 0).withColumn("reason", F.array_join("_reasons", "; ")).drop("_reasons")
    return good, bad


# ---------------------------------------------------------------- L11
def recategorise(t: Tables, mapping: DataFrame) -> Tables:
    """Rename (``new_value``) or delete (``new_value`` NULL) categories.

    Products follow by lower-cased value (missing = ``general``); a deleted
    category's products fall back to ``general``, which cannot be deleted.
    ``general`` may be renamed: its products, and those without a category, follow.
    ``mapping`` (old_value, new_value) is one row per category changed; what is
    refused is in ``recategorise_rejects``."""
    m = _mapping(mapping).filter(F.col("_reason").isNull()).select("_old", "_new")
    p = t.products.join(m, category_key() == F.col("_old"), "left")
    p = p.withColumn("category", F.when(F.col("_old").isNull(), F.col("category"))
                     .otherwise(F.coalesce("_new", F.lit("general")))).select(*t.products.columns)
    c = t.product_categories.join(m, F.lower("value") == F.col("_old"), "left")
    c = (c.filter(F.col("_old").isNull() | F.col("_new").isNotNull())
         .withColumn("value", F.coalesce("_new", "value")).select(*t.product_categories.columns))
    return t.with_tables(products=p, product_categories=c)


def _mapping(mapping: DataFrame) -> DataFrame:
    """Normalised mapping rows (one per distinct change), with the reason where one is refused."""
    m = mapping.select(F.lower(F.trim("old_value")).alias("_old"), F.lower(F.trim("new_value")).alias("_new")).distinct()
    several = m.groupBy("_old").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_old", "_o")
    m = m.join(several, F.col("_old").eqNullSafe(F.col("_o")))
    return m.withColumn("_reason", F.when(F.coalesce("_old", F.lit("")) == "", "old value missing")
                        .when(F.col("_n") > 1, "mapped to more than one value")
                        .when((F.col("_old") == "general") & F.col("_new").isNull(), "general cannot be deleted")).drop("_n", "_o")


def recategorise_rejects(mapping: DataFrame) -> DataFrame:
    """Rows of a mapping that ``recategorise`` refuses: (old_value, new_value, reason)."""
    return _mapping(mapping).filter(F.col("_reason").isNotNull()).select(
        F.col("_old").alias("old_value"), F.col("_new").alias("new_value"), F.col("_reason").alias("reason"))


# ---------------------------------------------------------------- L12
def adjust_levels(df: DataFrame, deltas: DataFrame, column: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``column += delta`` for active rows (deltas pre-summed per key).

    Returns (new table, rejects) where rejects are deltas for a missing or
    inactive key, with the reason."""
    d = deltas.groupBy(key).agg(F.sum("delta").alias("_d"))
    state = df.select(key, F.col("is_active").alias("_active"))
    j = d.join(state, key, "left")
    rejects = j.filter(F.col("_active").isNull() | (F.col("_active") != 1)).select(
        key, F.col("_d").alias("delta"),
        F.when(F.col("_active").isNull(), "not found").otherwise("inactive").alias("reason"))
    ok = j.filter(F.col("_active") == 1).select(key, "_d")
    dtype = df.schema[column].dataType
    new = df.join(ok, key, "left").withColumn(
        column, (F.col(column) + F.coalesce("_d", F.lit(0))).cast(dtype)).drop("_d").select(*df.columns)
    return new, rejects


__all__ = ["state_levels", "positions", "shop_statement", "apply_levels", "level_rejects", "append_facts", "merge_records", "merge_rejects", "recategorise_rejects",
           "delete_outcome", "delete_records", "normalise_master", "recategorise", "adjust_levels", "KEYS"]
