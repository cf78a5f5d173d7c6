import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from epitide.session import session

    s = session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
