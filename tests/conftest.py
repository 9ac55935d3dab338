import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    s = local_session("*", 4, "tests", **{"spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    p = Path("/root/testdata/sf0.001")
    if not p.exists():
        pytest.skip("no test tables here")
    return str(p)
