import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, TESTS]
# The Python workers import the functions of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join([TESTS, os.environ.get("PYTHONPATH", "")])

from trajloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "6g", "trajloom-tests")
