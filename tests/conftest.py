import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in sorted(os.listdir(data)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


def canon(v):
    """Values of both engines in one spelling: floats to six digits, structs and lists as tuples, times without zone."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(canon(x) for x in v.values())
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else v


def same_rows(df, con, sql):
    from collections import Counter

    cols = sorted(df.columns)
    ours = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
