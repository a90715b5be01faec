import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paddock.session import ship_package  # noqa: E402


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship_package(spark)
