import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidepanel.session import get_spark
    s = get_spark("local[4]", 4, app_name="tidepanel-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_panel(spark):
    from tidepanel.sources.fixtures import load_panel
    return load_panel(spark, SF_SMALL)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
