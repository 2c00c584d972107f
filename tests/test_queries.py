"""Every registered query against its SQL, and the entry point."""
import pytest

import __spark_entry__ as entry_point
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf) == ""


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["product_id", "user_id", "reminder_type", "as_of", "days_left", "is_urgent", "message"]
    assert df.count() > 0
