from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples; nulls come first."""

    def collect(df):
        return sorted(map(tuple, df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])

    return collect
