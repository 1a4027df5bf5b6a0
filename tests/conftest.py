import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skein.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": f"file://{folder}", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
