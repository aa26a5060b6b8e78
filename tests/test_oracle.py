import pytest

from tablehaul.queries import core

from .oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_matches_sql(spark, name):
    same(spark, core.QUERIES[name], core.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0
