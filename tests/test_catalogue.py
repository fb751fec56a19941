"""Every query of the catalogue against its SQL."""

import pytest
from compare import SF_DIR, duckdb_rows, spark_rows

from gridlark.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_are_those_of_the_sql(spark, name):
    assert name in ORACLES
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    assert (columns, rows) == duckdb_rows(ORACLES[name])
