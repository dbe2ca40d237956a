import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from washkit.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", app="washkit-tests", shuffle_partitions=8)
    yield s


def rows(df, order=None):
    """Collect as sorted list of dicts (deterministic comparisons)."""
    out = [r.asDict() for r in df.collect()]
    keys = order or (sorted(out[0].keys()) if out else [])
    return sorted(out, key=lambda d: tuple("" if d[k] is None else str(d[k]) for k in keys))
