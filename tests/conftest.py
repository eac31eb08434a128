import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Workers import the page functions of the tests.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")]
)

from folioflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "folioflow-tests", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def rows(frame):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple(map(str, r)))
