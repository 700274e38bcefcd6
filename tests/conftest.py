import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagewright.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    return local_session("8", **{"spark.checkpoint.dir": str(folder), "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
