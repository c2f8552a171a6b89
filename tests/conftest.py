import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from constellate.session import get_session

    folder = tmp_path_factory.mktemp("checkpoints").as_uri()
    s = get_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=folder)
    yield s
    s.stop()
