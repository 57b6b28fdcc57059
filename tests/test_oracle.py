"""Every registered query with oracle SQL matches DuckDB on sf0.001."""

from __future__ import annotations

import pytest

from routeledger.plans.catalog import REGISTRY
from routeledger.plans.compare import compare_one
from small_data import SF_SMALL

ORACLE = sorted(n for n, e in REGISTRY.items() if e.oracle is not None)


@pytest.mark.parametrize("name", ORACLE)
def test_matches_oracle(spark, duck, name):
    res = compare_one(spark, duck, name, SF_SMALL)
    assert res["status"] == "match", res


def test_every_survey_section_is_registered():
    ops = {e.operator for e in REGISTRY.values()}
    for prefix, count in (("A", 31), ("J", 15), ("T", 5), ("U", 3), ("C", 8)):
        missing = [f"{prefix}{i}" for i in range(1, count + 1) if f"{prefix}{i}" not in ops]
        assert not missing, missing
    for op in ("S1", "S4", "S5", "L1", "L2", "L3", "L4", "L5", "L6", "L7", "L8", "L9", "L10", "L11", "L12",
               "ST1", "ST2"):
        assert op in ops, op
