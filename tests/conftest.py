import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foliospark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def col(spark):
    """Value of one column expression over one text."""
    from pyspark.sql import functions as F

    def run(text, use):
        df = spark.createDataFrame([(text,)], "x string")
        return df.select(use(F.col("x")).alias("y")).first()[0]

    return run
