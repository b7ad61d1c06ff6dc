"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check
from workload.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF_DIR)


#: They read the stored space-time fit, whose written-out SQL would be too large; test_coarse_and_stored.py tests it.
STORED = {"smoothed_surface", "smoothed_exceedance_map", "smoothed_quantile_map", "smoothed_iqr_map"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == STORED and set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["zone", "hour", "level", "tail_prob"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, text = check.compare(spark, con, SF_DIR, name)
    assert ok, text
