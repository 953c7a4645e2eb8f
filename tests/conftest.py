import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rungwork.session import build_session

    session = build_session(8, "rungwork-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Rows of a DataFrame as dicts, sorted by the given columns."""

    def collect(df, *order):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out

    return collect
