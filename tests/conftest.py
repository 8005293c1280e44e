import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from terraloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    return local_session("tests", cores=4, partitions=4, **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
