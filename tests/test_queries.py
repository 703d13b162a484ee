"""Every query of the engine against DuckDB."""

import pytest
from compare import SF, oracle, rows

from __spark_entry__ import _own

OWN = _own()


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, name):
    f, sql = OWN[name]
    assert rows(f(spark, SF).toArrow()) == rows(oracle(sql))
