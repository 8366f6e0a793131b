import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mentionloom.session import local_session

    s = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=tempfile.mkdtemp(), spark__checkpoint__dir=tempfile.mkdtemp())
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no driver tables here")
    return SMALL
