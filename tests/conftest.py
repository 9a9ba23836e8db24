import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkwell.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=8, app="inkwell-tests")
    yield s


@pytest.fixture(scope="session")
def fixture_small(spark):
    from inkwell.plans.registry import tables_for
    return tables_for(spark, SF_SMALL)


@pytest.fixture(scope="session")
def fixture_mid(spark):
    from inkwell.plans.registry import tables_for
    return tables_for(spark, SF_MID)
