"""Every query with SQL against the oracle on the smallest tables."""

import os
from collections import Counter

import pandas as pd
import pytest

from helixframe.plans import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "-" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    return Counter(tuple(map(show, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, DIR).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).fetchdf())
