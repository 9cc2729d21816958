import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def compare(spark):
    """Runs named queries and their SQL on the smallest tables and compares the rows."""
    import glob
    from collections import Counter

    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")

    def plain(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if hasattr(v, "asDict"):
            v = v.asDict()
        if isinstance(v, dict):
            return tuple((k, plain(x)) for k, x in sorted(v.items()))
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def run(query, sql):
        df = query(spark, d)
        cols = sorted(df.columns)
        ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        theirs = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
        assert not (ours - theirs) and not (theirs - ours), (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])

    return run
