"""Every query with SQL must give exactly the rows of its SQL; the others must run."""

import oracle
import pytest

from barwright.plans import load_all

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    assert df.columns
