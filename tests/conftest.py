import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from zoomloom.session import local_session, ship

    s = local_session()
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def compare(spark):
    """Run a query and its SQL over the same tables and compare the rows."""
    import glob
    import math

    import duckdb

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 4)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    def run(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.toArrow().to_pylist())
        want = con.sql(sql)
        assert sorted(want.columns) == names
        at = [want.columns.index(c) for c in names]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())

    run.folder = folder
    return run
