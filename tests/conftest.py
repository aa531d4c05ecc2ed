import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docweave.session import local_session

    session = local_session(cores=4, memory="3g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL on the smallest tables, as multisets of rows."""
    import collections
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, ROOT)
        columns = sorted(df.columns)
        got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert got == want

    return check
