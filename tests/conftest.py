import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkprep.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def rows_of():
    """Rows as a sorted list of tuples, nulls included."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
