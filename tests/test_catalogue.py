import pytest

import __spark_entry__
from loomleaf.plans.catalogue import ORACLES, QUERIES
from oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, SF, QUERIES[name], ORACLES[name])
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
