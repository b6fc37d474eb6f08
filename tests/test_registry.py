"""Every query against its SQL, and the samplers' invariants."""

import pytest

from attestra.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, same, name):
    assert same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck(registry.ORACLES[name]))


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() == 2


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"estimand_preserving"}))
def test_samplers_do_not_depend_on_partitioning(spark, sf_dir, same, name):
    first = registry.QUERIES[name](spark, sf_dir).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        second = registry.QUERIES[name](spark, sf_dir).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(first) and same(first.round(6), second.round(6))
