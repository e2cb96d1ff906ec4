"""Every registered query against its SQL, on the smallest tables."""

import __spark_entry__ as contract
import pytest
from checking import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    found = contract.entry(spark)
    assert found.count() == 3 and {"pr_auc", "roc_auc", "fpr_at_tpr95"} <= set(found.columns)


def test_score_view_keys_are_unique(spark):
    from flowlens.operators.merge import duplicate_keys
    from flowlens.plans.views import scored
    for sf in ("sf0.001", "sf0.01"):
        assert duplicate_keys(scored(spark, f"/root/testdata/{sf}")).count() == 0
