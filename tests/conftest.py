import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from ledgerlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app_name="ledgerlens-tests", shuffle_partitions=8,
                            extra={"spark.driver.memory": "4g",
                                   "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ledgerlens-ckpt-")})
    yield session
    session.stop()
