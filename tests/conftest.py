import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from korvex.plans.util import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", cpus=4, partitions=4, memory="3g")
