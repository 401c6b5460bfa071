import __spark_entry__ as entry
import pytest
from tests.conftest import SF_SMALL
from tests.oracle import connect, rows
from tidegrid.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["m07_thinned", "m12_sharpened", "m16_despurred"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
