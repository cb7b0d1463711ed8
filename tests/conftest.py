import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tagstream.session import get_spark

    s = get_spark("local[*]", shuffle_partitions=8, app="tagstream-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from tagstream.plans.fixtures import Fixtures

    return Fixtures(spark, SMALL)


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="tagstream-test-", dir="/tmp")
