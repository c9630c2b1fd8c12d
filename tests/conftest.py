import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quantloom.runtime import session

    s = session(4, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows(spark):
    """rows(schema, [tuples]) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)
