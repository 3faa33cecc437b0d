"""Every registered query of the engine against its SQL."""

import os

import pytest
from compare import duck_rows, spark_rows

from tallyloom.plans import amounts, casework, claims, desk, feeds, history, reference, registry, verdicts  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, SF))
    assert (names, rows) == duck_rows(registry.ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_there_are_4224_configurations_and_372_pairs(spark):
    from tallyloom.plans.leaves import leaves, verdict_pairs, violations

    rows = leaves(spark)
    assert rows.count() == 4224 and rows.distinct().count() == 4224
    assert verdict_pairs(spark).count() == 372
    broken = rows.limit(3).unionByName(rows.limit(1).selectExpr(*[f"'FULL' AS {c}" if c == "r_payment" else f"'ABSENT' AS {c}" if c == "r_present" else c for c in rows.columns]))
    assert violations(broken).count() == 1
