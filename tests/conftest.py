import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]      # the package, and what the tests share


@pytest.fixture(scope="session")
def spark():
    from textsieve.session import local_session
    s = local_session(cores=8, shuffle_partitions=8, rebalance=8, app="textsieve-tests")
    yield s
    s.stop()
