import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fluxgrid.session import local_session

    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "3", "spark.driver.memory": "4g"})
    yield session
    session.stop()
