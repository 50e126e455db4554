import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemark import session

    s = session.build("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lake(spark):
    from tidemark.catalog.registry import lake_for

    return lake_for(spark, SF_DIR)


@pytest.fixture
def make(spark):
    """DataFrame from rows and a DDL schema; timestamps may be given as text."""

    def build(rows, ddl):
        from pyspark.sql import functions as F

        fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
        text = ", ".join(f"{n} {'string' if t in ('timestamp', 'date') else t}" for n, t in fields)
        return spark.createDataFrame(rows, text).select(
            *[F.col(n).cast(t).alias(n) for n, t in fields])

    return build


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
