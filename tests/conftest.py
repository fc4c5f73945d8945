import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from session import make_session

    return make_session(memory="6g")


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture
def rows(spark):
    """rows(schema, data) -> DataFrame without a Python worker round trip."""
    def make(schema, data):
        return spark.createDataFrame(data, schema)
    return make
