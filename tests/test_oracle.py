"""Every registered query against its DuckDB oracle (sf0.001; the driver checks sf0.01)."""

import pytest

from qlift.plans.check import compare, duck_connect
from qlift.plans.registry import load_all

SF_SMALL = "/root/testdata/sf0.001"

KEYS = sorted(load_all())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(spark, key, SF_SMALL, con)
    assert r["status"] in ("match", "rows-only"), r


def test_every_key_but_one_has_sql():
    missing = [k for k, s in load_all().items() if s.sql is None]
    assert not missing
