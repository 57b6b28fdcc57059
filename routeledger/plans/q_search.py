"""Registered queries of the contains-search by postings (F8, F9, U2, X7) with the oracle SQL of plain ``ilike``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text_index as X
from .catalog import FROM, REGISTRY, TO, _between, register
from .oracle_base import sql
from .q_listings import _MOVE_FROM, _RETURN_COLS, ISSUE_TERM
from .q_sources import _scratch

#: Terms of one character up to a whole word, with wildcards, and one that nothing holds.
_TERMS = ["e", "pr", "GEAR", "0012", "g%r", "b_l", "%", "no such text"]
_RETURN_TERM = "e F"


def _index(t) -> str:
    path = _scratch(t.products.sparkSession, "text-index")
    X.build(X.searched_texts(t), path)
    return path


@register("index_search_products", "F8", sql(f"""select x.term, p.id, p.code, p.name
from products p join (values {", ".join(f"('{s}')" for s in _TERMS)}) x(term)
  on p.code ilike concat('%', x.term, '%') or p.name ilike concat('%', x.term, '%')
where p.is_active = 1""", "products"))
def _f8_index(t):
    spark, path = t.products.sparkSession, _index(t)
    found = [X.search_products(spark, path, s).select(F.lit(s).alias("term"), "id", "code", "name") for s in _TERMS]
    return reduce(DataFrame.unionByName, found)


@register("index_search_all", "U2", REGISTRY["search_all"].oracle)
def _u2_index(t):
    return X.search_all(t.products.sparkSession, _index(t), "00001", 5)


@register("index_search_issues", "J9", REGISTRY["issues_enriched"].oracle)
def _j9_index(t):
    return X.issues_enriched(t, _index(t), ISSUE_TERM, FROM, TO)


@register("index_search_returns", "J10", sql(f"""select {_RETURN_COLS} from stock_returns sr {_MOVE_FROM.format(a='sr')}
where {_between('sr.date', FROM, TO)} and (p.name ilike '%{_RETURN_TERM}%' or p.code ilike '%{_RETURN_TERM}%'
  or sp.name ilike '%{_RETURN_TERM}%' or sp.code ilike '%{_RETURN_TERM}%' or sr.notes ilike '%{_RETURN_TERM}%')""",
                                            "stock_returns", "salespersons", "products"))
def _j10_index(t):
    return X.returns_enriched(t, _index(t), _RETURN_TERM, FROM, TO)
