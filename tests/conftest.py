import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loadcast.session import build_session, checkpoint_root

    s = build_session("local[4]", app_name="loadcast-tests", shuffle_partitions=4)
    checkpoint_root(s)
    yield s
    s.stop()


def rows(df, order=None):
    """Collected rows as plain dicts, sorted by ``order`` columns."""
    out = [r.asDict() for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in order))
    return out
