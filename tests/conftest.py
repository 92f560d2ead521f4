import os
import tempfile

import pytest

os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)


@pytest.fixture(scope="session")
def spark():
    from evifuse.session import get_spark

    s = get_spark(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="evifuse-tests-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
