import os
import shutil
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    folder = tempfile.mkdtemp(prefix="graphloom-tests-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = f"--conf spark.checkpoint.dir={folder} pyspark-shell"
    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)
