import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gleaner.session import local_session

    s = local_session(4, partitions=4, name="tests", driver_memory="3g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the smallest tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        p = f"{SMALL}/{f}"
        con.sql(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same_rows(df, con, sql):
    """Whether a query and its SQL twin have the same columns and rows, doubles to six places."""
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    r = con.sql(sql)
    assert sorted(r.columns) == sorted(df.columns)
    at = [r.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(text, x)) for x in df.collect()) == sorted(tuple(text(x[i]) for i in at) for x in r.fetchall())
