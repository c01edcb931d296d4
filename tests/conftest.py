import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("LOOM_DRIVER_MEMORY", "4g")

SMALL, ORACLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def duck():
    import compare

    return compare.duck(SMALL)
