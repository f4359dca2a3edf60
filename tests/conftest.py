import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from workloads.session import local_session

    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("tests", spark__checkpoint__dir=shared)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
