"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from graphquilt.session import local_session

    s = local_session(4, "tests", **{"spark__sql__shuffle__partitions": "4"})
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def of(df, *cols):
        return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)

    return of
