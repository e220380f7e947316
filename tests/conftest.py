import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from belfry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """``apply(fn, values...)``: run a Column function over literal text rows, results in order."""
    from pyspark.sql import functions as F

    def run(fn, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        schema = "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0])))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        cols = [F.col(f"c{k}") for k in range(len(rows[0]))]
        return [r["out"] for r in df.select("i", fn(*cols).alias("out")).orderBy("i").collect()]

    return run


@pytest.fixture
def scratch(spark):
    from belfry.session import scratch_path
    return lambda name: scratch_path(spark, name)
