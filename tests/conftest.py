import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)
