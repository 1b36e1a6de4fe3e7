import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from poolscope.schemas import schema  # noqa: E402
from poolscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 2)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Build a catalogue table from partial rows (dicts)."""

    def build(name, rows):
        fields = schema(name)
        full = [tuple(r.get(f.name) for f in fields) for r in rows]
        return spark.createDataFrame(full, fields)

    return build


def rows(df, *columns):
    return sorted(
        (tuple(r) for r in (df.select(*columns) if columns else df).collect()),
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )
