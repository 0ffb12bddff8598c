"""Every query of the training-data operators against its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from emberline.llm.oracles import ORACLES as SQL
from emberline.llm.queries import QUERIES

DATA = os.environ.get("EMBERLINE_TEST_DATA", "/root/testdata/sf0.001")


def _cell(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else repr(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(_cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
