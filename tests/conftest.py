import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from hybridlake.session import local_session

    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def record_file(tmp_path):
    from samples import RECORD_CSV

    path = tmp_path / "records.csv"
    path.write_text(RECORD_CSV)
    return str(path)
