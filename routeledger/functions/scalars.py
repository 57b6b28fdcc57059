"""X1..X10: the scalar rules of the reference as JVM-side Column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY

# Urgency labels and their sort ranks (X1), credit risk
# labels (X2) and stock status labels (X3), as the reference names them.
URGENCY_CRITICAL, URGENCY_HIGH, URGENCY_MEDIUM, URGENCY_LOW = "critical", "high", "medium", "low"
RISK_NO_CREDIT, RISK_NONE, RISK_HIGH, RISK_MEDIUM, RISK_LOW = (
    "No Credit", "No Outstanding", "High Risk", "Medium Risk", "Low Risk")
STOCK_LOW, STOCK_MEDIUM, STOCK_GOOD = "Low Stock", "Medium Stock", "Good Stock"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def urgency(stock="stock_quantity", minimum="min_stock_level") -> Column:
    """Critical at 0 or ≤ 25 % of the minimum, high ≤ 50 %, medium ≤ 75 %."""
    s, m = _c(stock), _c(minimum)
    return (F.when(s == 0, URGENCY_CRITICAL).when(s <= m * 0.25, URGENCY_CRITICAL)
             .when(s <= m * 0.5, URGENCY_HIGH).when(s <= m * 0.75, URGENCY_MEDIUM).otherwise(URGENCY_LOW))


def urgency_rank(stock="stock_quantity", minimum="min_stock_level") -> Column:
    """X1 sort key 0..4 (0 = out of stock)."""
    s, m = _c(stock), _c(minimum)
    return (F.when(s == 0, 0).when(s <= m * 0.25, 1).when(s <= m * 0.5, 2)
             .when(s <= m * 0.75, 3).otherwise(4))


def risk_level(balance="current_balance", limit="credit_limit") -> Column:
    """Credit risk of a shop from its balance (negative = owes)."""
    b, lim = _c(balance), _c(limit)
    return (F.when(lim == 0, RISK_NO_CREDIT).when(b >= 0, RISK_NONE)
             .when(F.abs(b) > lim * 0.8, RISK_HIGH).when(F.abs(b) > lim * 0.5, RISK_MEDIUM)
             .otherwise(RISK_LOW))


def stock_status(stock="stock_quantity", minimum="min_stock_level") -> Column:
    """Low ≤ minimum, Medium ≤ 2 × minimum, else Good."""
    s, m = _c(stock), _c(minimum)
    return F.when(s <= m, STOCK_LOW).when(s <= m * 2, STOCK_MEDIUM).otherwise(STOCK_GOOD)


def as_date(value) -> Column:
    """A date parameter or column; a malformed string becomes NULL (Q2),
    so a predicate on it selects nothing instead of failing the job."""
    if isinstance(value, Column):
        return value if value is not None else F.lit(None).cast("date")
    if value is None:
        return F.lit(None).cast("date")
    if isinstance(value, _dt.datetime):
        return F.lit(value.date())
    if isinstance(value, _dt.date):
        return F.lit(value)
    return F.try_to_date(F.lit(str(value)))


def day_of(col) -> Column:
    """X4 ``DATE(col)`` of a timestamp column."""
    return F.to_date(_c(col))


def days_before(as_of, days: int) -> Column:
    """X4 ``DATE(as_of, '-N days')``."""
    return F.date_sub(as_date(as_of), days)


def zero_if_null(col) -> Column:
    """X5 ``COALESCE(x, 0)`` keeping the column's type."""
    return F.coalesce(_c(col), F.lit(0))


def money_zero() -> Column:
    return F.lit(0).cast(MONEY)


def norm_code(col) -> Column:
    """Codes are trimmed and upper-cased."""
    return F.upper(F.trim(_c(col)))


def norm_name(col) -> Column:
    """Names are trimmed."""
    return F.trim(_c(col))


def like_pattern(term: str) -> str:
    """``%term%`` for ``ilike``.  ``%`` and ``_`` in the term stay
    wildcards as in the reference; a backslash is escaped so Spark does not
    reject the pattern (Q4)."""
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_ci(col, term: str) -> Column:
    """X7 case-insensitive ``LIKE '%term%'``."""
    return _c(col).ilike(like_pattern(term))


def to_id(col) -> Column:
    """X9 ``parseInt``: a bad value becomes NULL, callers split it out."""
    return _c(col).try_cast("bigint")


def tag(value: str, name: str = "type") -> Column:
    """X10 constant tag column."""
    return F.lit(value).alias(name)


def to_double(col) -> Column:
    """Money leaves an operator as double (exact decimal sums inside)."""
    return _c(col).cast("double")
