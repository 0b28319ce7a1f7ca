import os

import pytest


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("LACUNA_SF", "/root/testdata/sf0.001")
