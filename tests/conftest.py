import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adflow.session import get_session  # noqa: E402

T0 = 1_700_000_000  # seconds, a multiple of 10
T0_MS = T0 * 1000


@pytest.fixture(scope="session")
def spark():
    s = get_session("adflow-tests", master="local[4]",
                    conf={"spark.sql.shuffle.partitions": "4",
                          "spark.default.parallelism": "4"})
    yield s
    s.stop()


def ms(seconds: float) -> int:
    return int(T0_MS + seconds * 1000)


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
