"""One local session for all tests; tables of the smallest scale."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from docloom.session import session

    s = session("docloom-tests", master="local[4]", shuffle_partitions=4)
    s.conf.set("spark.sql.session.timeZone", "UTC")
    yield s
    s.stop()
