"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check
from gradus.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    check(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name], sf)


def test_every_statement_has_a_query():
    assert catalogue.ORACLE_SQL.keys() <= catalogue.QUERIES.keys()
