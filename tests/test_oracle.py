"""Every registered query next to its SQL in the other engine."""

import pytest
from check_oracle import compare, duck

import __spark_entry__ as entry

# needs more rows than the small tables have
MAY_BE_EMPTY = {"stream_failure_burst", "failure_burst", "over_estimated", "strong_peaks", "invalidate_models"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    msg = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql().get(name))
    assert msg is None or (msg == "both empty" and name in MAY_BE_EMPTY), msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_id", "reason", "to_partition", "to_mem", "to_min"] and df.count() > 0
