import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from simtrail.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="simtrail-tests-")
    session = build_session(
        master="local[4]",
        shuffle_partitions=8,
        app_name="simtrail-tests",
        extra_conf={
            "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            "spark.local.dir": os.path.join(scratch, "local"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="simtrail-out-")
