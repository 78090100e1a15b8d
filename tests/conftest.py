import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from furrow.session import get_spark

    session = get_spark("furrow-tests", cores=os.environ.get("TEST_CPUS", "4"), partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
