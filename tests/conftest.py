import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqbucket.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("FATAL")
    yield s


@pytest.fixture(scope="session")
def rows():
    """The rows of a DataFrame, sorted; arrays as tuples."""

    def plain(v):
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    return lambda df: sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
