import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers import the package and the model stand-ins of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")]
)

from clinspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=8)
