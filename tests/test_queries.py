"""Every registered query of the core library against its DuckDB SQL on the smallest tables."""

import pytest

from corpusmill import catalog
from tests.compare import differences

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    if name in ORACLES:
        assert differences(df, ORACLES[name], SF) == ""
    else:
        assert df.collect()
