"""The bundle of named DataFrames every operator takes as ``t``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    districts: DataFrame
    towns: DataFrame
    routes: DataFrame
    products: DataFrame
    product_categories: DataFrame
    salespersons: DataFrame
    shops: DataFrame
    sales: DataFrame
    sale_items: DataFrame
    collections: DataFrame
    salesperson_stock: DataFrame
    stock_issues: DataFrame
    stock_returns: DataFrame

    def get(self, name: str) -> DataFrame:
        if name not in self.names():
            raise KeyError(f"unknown table {name!r}")
        return getattr(self, name)

    def with_tables(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))
