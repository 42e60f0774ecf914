import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-test-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over pandas frames given as named views."""
    import duckdb

    def run(sql, **views):
        c = duckdb.connect()
        for name, frame in views.items():
            c.register(f"_{name}", frame)
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
        return c.sql(sql).df()

    return run


def rows(frame, columns=None):
    """Rows as comparable tuples, in any order.  Whole numbers compare as such: a null makes pandas turn a column to floats."""
    columns = sorted(columns or frame.columns)
    f = frame[columns].astype(object)
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(map(plain, r))) for r in f.where(f.notna(), None).itertuples(index=False, name=None))
