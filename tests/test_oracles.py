import pytest

from isoweave.plans import registry
from tests.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], D)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert not registry.queries()[name](spark, D).isEmpty()


def test_entry(spark):
    assert registry.entry(spark).count() == 445
