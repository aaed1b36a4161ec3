"""Every registered query against its SQL, or for rows when SQL cannot say it."""

import pytest
from catalogue import registry
from compare import compare

QUERIES, ORACLES = registry.all_queries(), registry.all_oracles()


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3


def test_no_imbalance_arm_is_left_out(spark, sf):
    assert {r.arm for r in QUERIES["sensitivity_imbalance_arms"](spark, sf).collect()} == {"none", "class_weight", "smote", "undersample"}
