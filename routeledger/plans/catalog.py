"""Registered queries: Spark callables and their DuckDB oracle SQL.

Every query reads the driver tables through the adapter (S3), over whole
tables.  Parameters are the fixture dates of FIXTURES.md; a LIMIT appears
only where paging or top-k is the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import star_from_testdata

# Fixed parameters (FIXTURES.md §2): ranges and days that return rows.
FROM, TO = "1998-01-01", "1998-12-31"
DAY, AS_OF = "1998-06-15", "1998-06-30"
CFROM, CTO, CDAY = "2024-01-01", "2024-01-31", "2024-01-15"


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[..., DataFrame]
    oracle: str | None
    operator: str  # SURVEY §2 id
    raw: bool = False  # build(spark, sf_dir) instead of build(tables)


REGISTRY: dict[str, Entry] = {}


def register(name: str, operator: str, oracle: str | None, raw: bool = False):
    def deco(fn: Callable[..., DataFrame]):
        REGISTRY[name] = Entry(name, fn, oracle, operator, raw)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = REGISTRY[name]
    if e.raw:
        return e.build(spark, sf_dir)
    return e.build(star_from_testdata(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, _n=n: run(_n, spark, sf_dir)) for n in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {n: e.oracle for n, e in REGISTRY.items() if e.oracle is not None}


def _d(s: str) -> str:
    return f"date '{s}'"


def _between(col: str, a: str, b: str) -> str:
    return f"cast({col} as date) between {_d(a)} and {_d(b)}"


def _m(expr: str, name: str) -> str:
    """Money/decimal expression leaving as double."""
    return f"cast({expr} as double) as {name}"


# Load all query modules so their @register decorators run.
from . import q_reports, q_listings, q_ledger, q_streams, q_chains, q_sources, q_master, q_closings, q_search  # noqa: E402,F401
