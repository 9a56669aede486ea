import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
if pathlib.Path("/opt/tokenizers").exists():
    sys.path.append("/opt/tokenizers")


@pytest.fixture(scope="session")
def spark():
    from cellweave.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, memory="4g", app="tests")
    yield session
    session.stop()
