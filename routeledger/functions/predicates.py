"""F1..F12: filters and batch lookups.

Filters are plain ``Column`` predicates so Catalyst pushes them to the
Parquet scan (``to_date(ts) between a and b`` is unwrapped into a pushed
timestamp range).  ``None`` means "no filter"; 0 is a real key (Q5).
Batch lookups are left-semi joins: the id side is deduplicated and goes
through the size-checked broadcast threshold, or a shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables
from .scalars import as_date, contains_ci, day_of


def _and(preds: Iterable[Column]) -> Column | None:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def where(df: DataFrame, *preds: Column | None) -> DataFrame:
    p = _and(preds)
    return df if p is None else df.filter(p)


def filter_equals(df: DataFrame, equals: dict) -> DataFrame:
    """AND of ``col = value``; unknown column names are refused.
    Equality with NULL matches nothing, as in SQL."""
    unknown = [c for c in equals if c not in df.columns]
    if unknown:
        raise ValueError(f"invalid filter column(s): {unknown}")
    return where(df, *[F.col(c) == F.lit(v) for c, v in equals.items()])


def active_only(df: DataFrame, flag: str = "is_active") -> DataFrame:
    """F2."""
    return df.filter(F.col(flag) == 1)


def date_range(col, from_=None, to_=None) -> Column | None:
    """F3 predicate: inclusive day range, either end open; bad dates select nothing."""
    d = day_of(col)
    preds = []
    if from_ is not None:
        preds.append(d >= as_date(from_))
    if to_ is not None:
        preds.append(d <= as_date(to_))
    return _and(preds)


def filter_dates(df: DataFrame, col: str = "date", from_=None, to_=None) -> DataFrame:
    """F3."""
    return where(df, date_range(col, from_, to_))


def _eq(col: str, v) -> Column | None:
    return None if v is None else F.col(col) == F.lit(v)


def filter_sales(df: DataFrame, salesperson_id=None, shop_id=None, route_id=None,
                 from_=None, to_=None, prefix: str = "") -> DataFrame:
    """optional FK and date filters on sales (or collections)."""
    p = prefix
    return where(df, date_range(f"{p}date", from_, to_), _eq(f"{p}salesperson_id", salesperson_id),
                 _eq(f"{p}shop_id", shop_id), _eq(f"{p}route_id", route_id))


def filter_shops(df: DataFrame, route_id=None, district_id=None, town_id=None,
                 active: bool = True) -> DataFrame:
    """location filters; the active flag defaults to on."""
    return where(df, _eq("route_id", route_id), _eq("district_id", district_id), _eq("town_id", town_id),
                 (F.col("is_active") == 1) if active else None)


def filter_returns(df: DataFrame, reason=None, condition=None, salesperson_id=None,
                   product_id=None, inspection_required=None) -> DataFrame:
    """return-specific filters."""
    return where(df, _eq("reason", reason), _eq("condition", condition), _eq("salesperson_id", salesperson_id),
                 _eq("product_id", product_id), _eq("inspection_required", inspection_required))


def id_frame(spark: SparkSession, ids, name: str = "id") -> DataFrame:
    """Ids given as a DataFrame pass through (deduplicated); a Python list
    becomes a small local relation."""
    if isinstance(ids, DataFrame):
        col = ids.columns[0]
        return ids.select(F.col(col).cast("bigint").alias(name)).distinct()
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} bigint").distinct()


def lookup(df: DataFrame, ids, key: str = "id") -> DataFrame:
    """rows of ``df`` whose ``key`` is in ``ids`` (point gets as a batch)."""
    keys = id_frame(df.sparkSession, ids, key)
    return df.join(keys, key, "left_semi")


def search_products(t: Tables, term: str) -> DataFrame:
    """F8: active products whose code or name contains ``term`` (any case)."""
    p = t.products
    return (p.filter((F.col("is_active") == 1) & (contains_ci("code", term) | contains_ci("name", term)))
             .orderBy("name", "id"))


def search_any(cols: Iterable[str], term: str | None) -> Column | None:
    """F9 predicate: OR of contains-searches over ``cols``."""
    if not term:
        return None
    return reduce(lambda a, b: a | b, [contains_ci(c, term) for c in cols])


def search_movements(df: DataFrame, term: str | None, cols: Iterable[str]) -> DataFrame:
    """rows of an enriched issue/return listing whose given columns
    contain ``term`` (any case); no term = no filter."""
    return where(df, search_any(cols, term))


def towns_in_district(t: Tables, district_ids) -> DataFrame:
    """towns of the given districts."""
    return lookup(t.towns, district_ids, "district_id").orderBy("name", "id")


def routes_in_town(t: Tables, town_ids) -> DataFrame:
    """routes of the given towns with the town name."""
    r = lookup(t.routes, town_ids, "town_id")
    towns = t.towns.select(F.col("id").alias("town_id"), F.col("name").alias("town_name"))
    return r.join(towns, "town_id", "left").orderBy("name", "id")


def category_key(col="category") -> Column:
    """Products join categories by lower-cased value; missing = ``general``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.coalesce(c, F.lit("general")))


def products_in_category(t: Tables, values: Iterable[str]) -> DataFrame:
    """F12."""
    vals = [v.lower() for v in values]
    return t.products.filter(category_key().isin(vals))
