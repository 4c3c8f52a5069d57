import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lever.session import local_session
    s = local_session("*", shuffle_partitions=8, app="lever-tests")
    yield s


@pytest.fixture(scope="session")
def f2_small(spark):
    from lever.sources import lineitem_series
    return lineitem_series(spark, SF001).persist()
