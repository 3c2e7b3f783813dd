import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paraspark.session import build_session
    scratch = tempfile.mkdtemp(prefix="paraspark-test-")
    os.environ.setdefault("PARASPARK_LOCAL_SCRATCH", scratch + "/ckpt")
    s = build_session("local[4]", shuffle_partitions=4, app_name="paraspark-tests",
                      extra={"spark.local.dir": scratch + "/local"})
    yield s
    s.stop()


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)
