import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from remitspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", 8, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture
def day():
    return lambda text: dt.date.fromisoformat(text)


def rows(df, *columns):
    """Sorted tuples of a small result."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def as_rows():
    return rows
