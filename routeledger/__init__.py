"""routeledger: field-sales analytics on Spark DataFrames.

Typed field-sales tables, enriched listings and search, reports, a
stock-and-credit ledger with exact batch admission, integrity checks and
streaming forms, all as lazy DataFrame plans.
"""

from .tables import Tables  # noqa: F401

__version__ = "0.1.0"
