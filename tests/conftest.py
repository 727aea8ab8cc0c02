import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from postlake.session import build_session

    session = build_session("tests", cores=8)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
