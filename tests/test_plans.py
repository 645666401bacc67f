"""Every named plan gives the rows of its SQL twin."""

from __future__ import annotations

import oracle
import pytest

from quernstone.plans import all_plans

PLANS = all_plans()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.filterwarnings("ignore:.*buckets in use")
@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql is not None])
def test_plan_equals_sql(spark, sf_dir, con, name):
    plan = PLANS[name]
    assert oracle.differences(plan.query(spark, sf_dir), con, plan.sql) == []


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql is None])
def test_plan_without_sql_has_rows(spark, sf_dir, name):
    assert PLANS[name].query(spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
