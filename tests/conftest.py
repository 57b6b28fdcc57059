from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from small_data import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from routeledger.session import build_session
    # A checkpoint folder of our own only when the session names none.
    s = build_session(master="local[4]", shuffle_partitions=4,
                      checkpoint_fallback=tempfile.mkdtemp(prefix="routeledger-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def star(spark):
    from routeledger.sources.testdata import star_from_testdata
    return star_from_testdata(spark, SF_SMALL)


@pytest.fixture(scope="session")
def seed(spark):
    from seed import seed_tables
    return seed_tables(spark)


@pytest.fixture(scope="session")
def duck():
    from routeledger.plans.compare import duck_connect
    return duck_connect(SF_SMALL)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="routeledger-test-")
