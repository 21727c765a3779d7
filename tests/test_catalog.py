"""Every registered query against its oracle on the smallest tables (skipped where the data is absent)."""

import os

import pytest

from oracle_check import compare, duck
from parcelspark.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
# covered by tests/test_rasters_and_selection.py; minutes of iteration on whole rasters
SLOW = {"calibration_trials"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(CATALOG) - SLOW))
def test_query_matches_oracle(spark, con, name):
    q = CATALOG[name]
    rows, result = compare(spark, con, name, q.run, q.oracle, SF)
    if result is not None:
        assert result[0], f"{name}: {rows} rows against {result[1]}; first differences {result[2]}"
