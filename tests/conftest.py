import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chunkgraph.schemas import CHUNKS  # noqa: E402
from chunkgraph.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="chunkgraph-tests")
    yield s
    s.stop()


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="chunkgraph-test-", dir="/tmp")


def chunk_row(id_, name, path, type_, content, parent=None, line=1, body=None, doc=None,
              calls=()):
    return (id_, path, name, type_, content, parent, line, body, doc, list(calls), "")


# A mill: ``serve`` calls ``knead``; ``knead`` and ``rise`` call each other; ``rise`` calls
# itself and a name that is nowhere; ``sweep`` is on its own.
MILL = [chunk_row(11, "serve", "mill/shop.py", "function", "def serve(who):\n    return knead(who)",
                  line=3, body=4, calls=["knead"]),
        chunk_row(12, "knead", "mill/dough.py", "method", "def knead(self, t):\n    rise(t)", "Dough", 8, 9,
                  doc="Work the dough.", calls=["rise"]),
        chunk_row(13, "rise", "mill/dough.py", "method", "def rise(t):\n    knead(t); rise(t - 1); wait()", "Dough",
                  20, 21, calls=["knead", "rise", "wait"]),
        chunk_row(14, "sweep", "tests/test_floor.py", "async_function", "async def sweep():\n    pass", line=1, body=2)]


@pytest.fixture
def mill(spark):
    return spark.createDataFrame(MILL, CHUNKS)
