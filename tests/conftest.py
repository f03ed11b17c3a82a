import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from cohortwise.session import build_session

    return build_session("tests", partitions=4, **{"spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
