"""Every quick query agrees with its SQL oracle on the smallest scale factor."""

import re

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import duck, value_hash

FAST = re.compile(r"^(r\d|c0|c1|s0|s1|st|d0|d1|d2|d3|d4|e19|e20|t0|t1|t2|e2[4-9]|e3|k01|g01|g03|ql_)")


def _keys():
    from __spark_entry__ import oracle_sql
    return sorted(k for k in oracle_sql() if FAST.search(k))


@pytest.mark.parametrize("key", _keys())
def test_matches_oracle(spark, key):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    ocols, orows = duck(SF_SMALL, oracle_sql()[key])
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert value_hash(df.columns, rows)[0] == value_hash(ocols, orows)[0]
