import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from spanwright.session import local_session

    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
