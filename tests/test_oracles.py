"""Every query of the customer platform against its SQL."""

import math
from decimal import Decimal

import pytest

from tidewater.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLES[name]}) q").fetchall()
    rows = lambda of: sorted(repr(tuple(map(plain, r))) for r in of)
    assert rows(df.select(*cols).collect()) == rows(want)


def test_rows_without_sql(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf_dir).count() > 0
